"""Event cascades: range join of events to segments, leakage-safe features, audits and recounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.links import is_canonical_id
from ..functions.numeric import number_from_text
from .ordered import HOT_ROWS, with_previous
from .splits import outside_coverage, paper_split, strict_split

# The two prediction cutoffs and the label horizon in seconds.
CUTOFFS = (900, 3600)
HORIZON = 86400
LONG_TAIL = 1209600
SMALL_SEGMENT = 50
CELL = 1024
COARSE = 1024 * 1024


def broken_ranges(index: DataFrame) -> DataFrame:
    """Segments whose range does not start right after the previous segment's end.

    Sequence numbers are dense, so the previous segment is found with an equi-join instead of
    one global window.
    """
    previous = index.select((F.col("sequence") + 1).alias("sequence"), F.col("end_ind").alias("_prev_end"))
    rows = index.join(previous, "sequence", "left")
    expected = F.coalesce(F.col("_prev_end") + 1, F.when(F.col("sequence") == 1, F.lit(1)))
    return rows.filter(
        expected.isNull() | (F.col("start_ind") != expected) | (F.col("end_ind") < F.col("start_ind"))
    ).select("sequence", "start_ind", "end_ind", expected.alias("expected_start"))


def segment_cells(index: DataFrame) -> DataFrame:
    """One row per cell a segment touches, exploded in two levels so no array grows with a segment."""
    coarse = index.withColumn(
        "_coarse",
        F.explode(F.sequence(F.floor(F.col("start_ind") / COARSE), F.floor(F.col("end_ind") / COARSE))),
    )
    low = F.greatest(F.floor(F.col("start_ind") / CELL), F.col("_coarse") * (COARSE // CELL))
    high = F.least(F.floor(F.col("end_ind") / CELL), (F.col("_coarse") + 1) * (COARSE // CELL) - 1)
    return coarse.withColumn("_cell", F.explode(F.sequence(low, high))).drop("_coarse")


def assign_events(index: DataFrame, events: DataFrame) -> DataFrame:
    """Attach every event to the segment whose range holds its ordinal.

    Events meet segments on fixed cells of 1024 ordinals, so a huge segment is spread over many
    keys; the range test is a residual filter. A small index is broadcast.
    """
    cells = segment_cells(index.select("sequence", "start_ind", "end_ind"))
    placed = events.withColumn("_cell", F.floor(F.col("ordinal") / CELL))
    return (
        placed.join(cells, "_cell")
        .filter(F.col("ordinal").between(F.col("start_ind"), F.col("end_ind")))
        .withColumn("is_origin", F.col("ordinal") == F.col("start_ind"))
        .drop("_cell")
    )


def bad_origins(assigned: DataFrame) -> DataFrame:
    """Segments whose first event is not at time zero."""
    t = number_from_text(F.col("relative_time_second"))
    return assigned.filter(F.col("is_origin") & ~t.eqNullSafe(F.lit(0.0))).select("sequence", "ordinal")


def id_flags(index: DataFrame) -> DataFrame:
    """Segments with the two identity faults: a non-canonical raw id, or an id that repeats."""
    repeated = (
        index.groupBy("tweet_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).drop("_n")
    )
    rows = index.join(repeated.withColumn("_rep", F.lit(True)), "tweet_id", "left")
    return rows.withColumn("noncanonical_id", ~is_canonical_id(F.col("tweet_id"))).withColumn(
        "repeated_raw_id", F.coalesce(F.col("_rep"), F.lit(False))
    ).drop("_rep")


def quarantined_ids(flags: DataFrame) -> DataFrame:
    return flags.filter(F.col("noncanonical_id") | F.col("repeated_raw_id")).select(
        F.col("sequence").alias("segment_index"),
        F.substring(F.sha2("tweet_id", 256), 1, 12).alias("raw_id_hash_prefix"),
        "post_time_day",
        "start_ind",
        "end_ind",
        "noncanonical_id",
        "repeated_raw_id",
    )


def usable_segments(flags: DataFrame) -> DataFrame:
    return flags.filter(~F.col("noncanonical_id") & ~F.col("repeated_raw_id"))


def coverage(index: DataFrame) -> DataFrame:
    """Identity and time coverage of the index in one row."""
    per_id = index.groupBy("tweet_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("post_time_day").alias("low"),
        F.max("post_time_day").alias("high"),
        F.max("end_ind").alias("end_ind"),
    )
    canonical, n = is_canonical_id(F.col("tweet_id")), F.col("n")
    good = canonical & (n == 1)
    return per_id.agg(
        F.sum("n").alias("index_rows"),
        F.count(F.lit(1)).alias("unique_raw_id_strings"),
        F.count_if(canonical).alias("canonical_unique_id_strings"),
        F.sum(F.when(canonical, n).otherwise(0)).alias("canonical_segments"),
        F.sum(F.when(~canonical, n).otherwise(0)).alias("noncanonical_segments"),
        F.count_if(n > 1).alias("repeated_id_count"),
        F.sum(F.when(~good, n).otherwise(0)).alias("quarantined_segments"),
        F.count_if(good).alias("usable_unique_cascades"),
        F.min("low").alias("min_post_time_day"),
        F.max("high").alias("max_post_time_day"),
        F.max("end_ind").alias("indexed_event_rows"),
    )


def cascades_by_day(index: DataFrame) -> DataFrame:
    return index.groupBy(F.floor("post_time_day").cast("bigint").alias("day")).agg(
        F.count(F.lit(1)).alias("n_cascades")
    )


def timed_events(assigned: DataFrame) -> DataFrame:
    """Events without the origin, with their time as a number."""
    return assigned.filter(~F.col("is_origin")).withColumn(
        "t", number_from_text(F.col("relative_time_second"))
    )


def cascade_counts(assigned: DataFrame) -> DataFrame:
    """Per segment: counts and first and last time up to each cutoff, in one combined aggregate."""
    t = F.col("t")
    aggregates: list[Column] = []
    for c in CUTOFFS:
        seen = F.when(t <= c, t)
        aggregates += [
            F.count(seen).alias(f"n_{c}"),
            F.min(seen).alias(f"first_{c}"),
            F.max(seen).alias(f"last_{c}"),
        ]
    return timed_events(assigned).groupBy("sequence").agg(
        *aggregates, F.count(F.when(t <= HORIZON, t)).alias(f"n_{HORIZON}"), F.count(F.lit(1)).alias("n_events")
    )


def features(usable: DataFrame, counts: DataFrame) -> DataFrame:
    """Two rows per cascade, one per cutoff; nothing after the cutoff enters a feature."""
    day = F.col("post_time_day")
    rows = usable.select("sequence", "post_time_day").join(counts, "sequence", "left")
    variants = F.array(
        *[
            F.struct(
                F.lit(c).alias("cutoff_seconds"),
                F.coalesce(F.col(f"n_{c}"), F.lit(0)).alias("observed_retweet_count"),
                F.col(f"first_{c}").alias("first_observed_retweet_seconds"),
                F.col(f"last_{c}").alias("last_observed_retweet_seconds"),
                (F.coalesce(F.col(f"n_{HORIZON}"), F.lit(0)) - F.coalesce(F.col(f"n_{c}"), F.lit(0))).alias(
                    "future_retweets_to_24h"
                ),
                F.coalesce(F.col(f"n_{HORIZON}"), F.lit(0)).alias("total_retweets_at_24h"),
            )
            for c in CUTOFFS
        ]
    )
    return rows.filter(~outside_coverage(day)).select(
        F.format_string("cascade-%06d", F.col("sequence")).alias("cascade_id"),
        "post_time_day",
        paper_split(day).alias("paper_day_split"),
        strict_split(day).alias("strict_label_available_split"),
        (day + 1).alias("label_available_day"),
        F.explode(variants).alias("_v"),
    ).select(
        "cascade_id",
        "post_time_day",
        "_v.cutoff_seconds",
        "paper_day_split",
        "strict_label_available_split",
        "_v.observed_retweet_count",
        "_v.first_observed_retweet_seconds",
        "_v.last_observed_retweet_seconds",
        "_v.future_retweets_to_24h",
        "_v.total_retweets_at_24h",
        "label_available_day",
    )


def group_totals(feature_rows: DataFrame) -> DataFrame:
    observed, future = F.col("observed_retweet_count"), F.col("future_retweets_to_24h")
    return feature_rows.groupBy("cutoff_seconds", "strict_label_available_split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(observed == 0).alias("cold_at_cutoff"),
        F.sum(observed).alias("observed_total"),
        F.sum(future).alias("future_total"),
        F.count_if(future > 0).alias("future_positive"),
    )


def unsorted_transitions(assigned: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per segment: how often an event is earlier than the event recorded before it."""
    rows = with_previous(
        timed_events(assigned).select("sequence", "ordinal", "t"), ["sequence"], "ordinal", ["t"], (), hot_rows
    )
    return rows.groupBy("sequence").agg(F.count_if(F.col("t") < F.col("prev.t")).alias("unsorted"))


def source_anomalies(assigned: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Anomaly counters over the full source segments, in one row."""
    t, raw = F.col("t"), F.col("relative_time_second")
    per_segment = timed_events(assigned).groupBy("sequence").agg(
        F.count_if(F.lower(raw).contains("e")).alias("sci"),
        F.count_if(t != F.floor(t)).alias("frac"),
        F.count_if(t > LONG_TAIL).alias("beyond"),
        F.count(F.lit(1)).alias("n"),
        F.max(t).alias("max_t"),
    )
    # Segments with only their origin have no timed event but still count as small.
    segments = assigned.filter("is_origin").select("sequence").join(per_segment, "sequence", "left")
    unsorted = unsorted_transitions(assigned, hot_rows).agg(F.sum("unsorted").alias("unsorted_event_transitions"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return segments.agg(
        F.coalesce(F.sum("sci"), F.lit(0)).alias("scientific_notation_event_times"),
        F.coalesce(F.sum("frac"), F.lit(0)).alias("fractional_second_events"),
        F.coalesce(F.sum("beyond"), F.lit(0)).alias("events_beyond_14d"),
        F.count_if(n < SMALL_SEGMENT).alias("segments_below_documented_50_retweets"),
        F.min(n).alias("minimum_retweet_events_per_segment"),
        F.max("max_t").alias("maximum_event_second"),
    ).join(F.broadcast(unsorted), F.lit(True))


def partition_audit(feature_rows: DataFrame) -> DataFrame:
    """Cascades per outer and inner partition and how many are cold, per cutoff."""
    from .splits import inner_split

    outer = F.col("strict_label_available_split")
    inner = F.when(outer == "train_candidate", inner_split(F.col("post_time_day"))).otherwise("outside_train")
    return feature_rows.groupBy("cutoff_seconds", outer.alias("outer_split"), inner.alias("inner_split")).agg(
        F.count(F.lit(1)).alias("n_cascades"), F.count_if(F.col("observed_retweet_count") == 0).alias("n_cold")
    )


def label_recount(
    feature_rows: DataFrame, assigned: DataFrame, probes: int | None = None
) -> DataFrame:
    """Recount the labels of the first ``probes`` cascades from the source by direct inequality.

    ``None`` checks every cascade. Rows with ``matches`` false are label errors.
    """
    sequence = F.substring_index(F.col("cascade_id"), "-", -1).cast("bigint")
    wanted = feature_rows.withColumn("sequence", sequence)
    events = timed_events(assigned)
    if probes is not None:
        picked = wanted.select("sequence").distinct().orderBy("sequence").limit(probes)
        wanted = wanted.join(F.broadcast(picked), "sequence", "left_semi")
        events = events.join(F.broadcast(picked), "sequence", "left_semi")
    t = F.col("t")
    recount = events.groupBy("sequence").agg(
        *[F.count_if((t > c) & (t <= HORIZON)).alias(f"r_{c}") for c in CUTOFFS]
    )
    chosen = F
    for c in CUTOFFS:
        chosen = chosen.when(F.col("cutoff_seconds") == c, F.col(f"r_{c}"))
    rows = wanted.join(recount, "sequence", "left").withColumn("recounted", F.coalesce(chosen, F.lit(0)))
    return rows.select(
        "cascade_id",
        "cutoff_seconds",
        F.col("future_retweets_to_24h").alias("stored"),
        "recounted",
        (F.col("recounted") == F.col("future_retweets_to_24h")).alias("matches"),
    )


def feature_vector() -> Column:
    """The five model inputs; an allow-list without target, id, day or split."""
    observed, cutoff = F.col("observed_retweet_count"), F.col("cutoff_seconds")
    return F.array(
        F.log1p(observed.cast("double")),
        F.coalesce(F.col("first_observed_retweet_seconds") / cutoff, F.lit(0.0)),
        F.coalesce(F.col("last_observed_retweet_seconds") / cutoff, F.lit(0.0)),
        (observed == 0).cast("double"),
        cutoff / F.lit(86400.0),
    )

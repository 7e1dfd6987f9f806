"""Consecutive-interval operators over timed counters (deltas, rates, slopes, revisions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import event_ratio, is_finite, per_thousand, ratio_reason, safe_ratio
from ..functions.times import midpoint, seconds_between
from .ordered import HOT_ROWS, as_of, find_hot, first_of, last_of, running_position, with_previous

PUBLIC_COUNTERS = ("views", "replies", "likes", "reposts", "bookmarks")
OWNER_COUNTERS = ("impressions", "engagements", "detail_expands", "profile_visits", "link_clicks")
# Output ratio name to the counter that is divided by impressions.
EVENT_RATIOS = {
    "engagement_events_per_impression": "engagements",
    "detail_expands_per_impression": "detail_expands",
    "profile_visits_per_impression": "profile_visits",
    "link_clicks_per_impression": "link_clicks",
}


def skip_reasons(df: DataFrame, value: str, time: str = "observed_at") -> DataFrame:
    """Tag rows that cannot enter an interval; the rows are kept, never invented or zeroed."""
    return df.withColumn(
        "skip_reason",
        F.when(F.col(time).isNull(), "missing_exact_timestamp").when(
            F.col(value).isNull(), "missing_count"
        ),
    )


def split_usable(df: DataFrame, value: str, time: str = "observed_at") -> tuple[DataFrame, DataFrame]:
    tagged = skip_reasons(df, value, time)
    usable = tagged.filter(F.col("skip_reason").isNull()).drop("skip_reason")
    return usable, tagged.filter(F.col("skip_reason").isNotNull())


def skip_summary(df: DataFrame, keys: Sequence[str], value: str, time: str = "observed_at") -> DataFrame:
    """Number of skipped observations per reason."""
    _, skipped = split_usable(df, value, time)
    return skipped.groupBy(*keys, "skip_reason").agg(F.count(F.lit(1)).alias("n_skipped"))


def intervals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    time: str = "observed_at",
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | bool | None = None,
) -> DataFrame:
    """One row per pair of consecutive usable observations of a series."""
    usable, _ = split_usable(df, value, time)
    base = usable.select(*keys, time, *[t for t in tie if t not in keys], value)
    paired = with_previous(base, keys, time, [value], tie, hot_rows, hot=hot).filter(F.col("prev").isNotNull())
    start, end = F.col(f"prev.{time}"), F.col(time)
    seconds = seconds_between(start, end)
    delta = F.col(value) - F.col(f"prev.{value}")
    return paired.select(
        *keys,
        start.alias("started_at"),
        end.alias("ended_at"),
        seconds.alias("interval_seconds"),
        midpoint(start, end).alias("midpoint_at"),
        F.col(f"prev.{value}").alias("count_before"),
        F.col(value).alias("count_after"),
        delta.alias("net_delta"),
        safe_ratio(delta, seconds).alias("net_rate_per_second"),
        (safe_ratio(delta, seconds) * 3600).alias("net_rate_per_hour"),
    )


def accelerations(
    rates: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, hot: DataFrame | bool | None = None
) -> DataFrame:
    """Change of the interval rate over the distance between interval midpoints."""
    paired = with_previous(
        rates,
        keys,
        "ended_at",
        ["interval_seconds", "net_rate_per_second", "midpoint_at"],
        hot_rows=hot_rows,
        hot=hot,
    ).filter(F.col("prev").isNotNull())
    distance = (F.col("prev.interval_seconds") + F.col("interval_seconds")) / 2
    slope = safe_ratio(F.col("net_rate_per_second") - F.col("prev.net_rate_per_second"), distance)
    return paired.select(
        *keys,
        F.col("prev.midpoint_at").alias("from_midpoint_at"),
        F.col("midpoint_at").alias("to_midpoint_at"),
        F.col("ended_at"),
        distance.alias("midpoint_interval_seconds"),
        slope.alias("acceleration_per_second_squared"),
        (slope * (3600.0 * 3600.0)).alias("acceleration_per_hour_squared"),
    )


def weighted_rate(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    time: str = "observed_at",
    tie: Sequence[str] = (),
) -> DataFrame:
    """First-to-last change over elapsed time; not the mean of the interval rates."""
    usable, _ = split_usable(df, value, time)
    ends = usable.groupBy(*keys).agg(
        first_of([time, value], [time, *tie]), last_of([time, value], [time, *tie])
    )
    seconds = seconds_between(F.col(f"first.{time}"), F.col(f"last.{time}"))
    delta = F.col(f"last.{value}") - F.col(f"first.{value}")
    return ends.filter(seconds > 0).select(
        *keys,
        F.col(f"first.{time}").alias("started_at"),
        F.col(f"last.{time}").alias("ended_at"),
        seconds.alias("interval_seconds"),
        delta.alias("net_delta"),
        safe_ratio(delta, seconds).alias("net_rate_per_second"),
        (safe_ratio(delta, seconds) * 3600).alias("net_rate_per_hour"),
    )


def counter_intervals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    time: str = "observed_at",
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Intervals of a cumulative counter: a fall is a revision and has no observed rate."""
    rows = intervals(df, keys, value, time, tie, hot_rows)
    revised = F.col("net_delta") < 0
    return rows.withColumn(
        "status", F.when(revised, "counter_revision").otherwise("observed_counter_change")
    ).withColumn("observed_rate_per_second", F.when(~revised, F.col("net_rate_per_second")))


def last_two_rates(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tolerance: float = 0.2,
    time: str = "observed_at",
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Compare the per-minute rates of the last two intervals of every series."""
    hot = find_hot(df.filter(F.col(time).isNotNull()), keys, time, hot_rows)
    rates = intervals(df, keys, value, time, tie, hot=hot)
    rates = rates.select(
        *keys,
        "started_at",
        "ended_at",
        "net_delta",
        (F.col("interval_seconds") / 60).alias("minutes"),
        (F.col("net_delta") / (F.col("interval_seconds") / 60)).alias("per_minute"),
    )
    pairs = with_previous(rates, keys, "ended_at", ["started_at", "ended_at", "minutes", "per_minute"], hot=hot)
    latest = pairs.groupBy(*keys).agg(
        last_of(["started_at", "ended_at", "minutes", "per_minute", "prev"], ["ended_at"])
    )
    minutes, before = F.col("last.minutes"), F.col("last.prev.minutes")
    rate, rate_before = F.col("last.per_minute"), F.col("last.prev.per_minute")
    difference = F.abs(minutes - before) / before
    return latest.select(
        *keys,
        F.col("last.prev.started_at").alias("previous_started_at"),
        F.col("last.prev.ended_at").alias("previous_ended_at"),
        F.col("last.started_at").alias("latest_started_at"),
        F.col("last.ended_at").alias("latest_ended_at"),
        rate_before.alias("previous_rate_per_minute"),
        rate.alias("latest_rate_per_minute"),
        F.when(before.isNull(), "insufficient_intervals")
        .otherwise("observed_net_rates_only")
        .alias("status"),
        difference.alias("duration_relative_difference"),
        (difference <= tolerance).alias("within_duration_budget"),
        F.when(rate > rate_before, "increased")
        .when(rate < rate_before, "decreased")
        .when(rate == rate_before, "unchanged")
        .alias("net_rate_direction"),
    )


def rolling_intervals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    time: str = "observed_at",
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Intervals of a rolling-window counter, where a decline is legitimate expiry."""
    rows = intervals(df, keys, value, time, tie, hot_rows)
    return rows.withColumn(
        "change_status",
        F.when(F.col("net_delta") < 0, "rolling_net_decline_possible_expiry")
        .when(F.col("net_delta") > 0, "rolling_net_increase")
        .otherwise("rolling_net_unchanged"),
    )


def paired_counter_intervals(
    df: DataFrame,
    keys: Sequence[str],
    counters: Sequence[str] = OWNER_COUNTERS,
    time: str = "observed_at",
    source: str | None = "source",
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Multi-counter intervals between consecutive captures with the same declared source.

    If any counter fell the whole interval is a revision and all of its estimates are null;
    a counter that is merely unknown on either side nulls only itself.
    """
    carried = [*counters] + ([source] if source else [])
    base = df.select(*keys, time, *[t for t in tie if t not in keys], *carried)
    rows = with_previous(base, keys, time, carried, tie, hot_rows).filter(F.col("prev").isNotNull())
    if source:
        rows = rows.filter(F.col(f"prev.{source}").eqNullSafe(F.col(source)))
    elapsed = seconds_between(F.col(f"prev.{time}"), F.col(time))
    revised = F.filter(
        F.array(*[F.when(F.col(c) < F.col(f"prev.{c}"), F.lit(c)) for c in counters]),
        lambda item: item.isNotNull(),
    )
    rows = rows.withColumn("elapsed_seconds", elapsed).withColumn("revised_counters", revised)
    is_revised = F.size("revised_counters") > 0
    delta = {c: F.when(~is_revised, F.col(c) - F.col(f"prev.{c}")) for c in counters}
    out = [
        *keys,
        F.col(f"prev.{time}").alias("started_at"),
        F.col(time).alias("ended_at"),
        "elapsed_seconds",
        F.when(is_revised, "counter_revision").otherwise("paired").alias("status"),
        "revised_counters",
    ]
    for c in counters:
        unknown = F.col(c).isNull() | F.col(f"prev.{c}").isNull()
        out += [
            delta[c].alias(f"delta_{c}"),
            F.when(is_revised, "counter_revision")
            .when(unknown, "unknown_counter")
            .alias(f"delta_{c}_reason"),
            safe_ratio(delta[c], F.col("elapsed_seconds")).alias(f"{c}_per_second"),
        ]
    if "impressions" in counters:
        for name, c in EVENT_RATIOS.items():
            ratio = event_ratio(delta[c], delta["impressions"])
            out += [
                ratio.alias(name),
                F.when(is_revised, "counter_revision")
                .otherwise(ratio_reason(delta["impressions"], delta[c]))
                .alias(f"{name}_reason"),
                per_thousand(ratio).alias(f"{c}_per_1000_impressions"),
            ]
    return rows.select(*out)


def with_event_ratios(df: DataFrame) -> DataFrame:
    """Four event ratios of a capture, the reason each one is missing, and the rate per thousand."""
    out = df
    for name, c in EVENT_RATIOS.items():
        ratio = event_ratio(F.col(c), F.col("impressions"))
        out = (
            out.withColumn(name, ratio)
            .withColumn(f"{name}_reason", ratio_reason(F.col("impressions"), F.col(c)))
            .withColumn(f"{c}_per_1000", per_thousand(ratio))
        )
    return out


def relative_growth(rates: DataFrame) -> DataFrame:
    """Net growth per starting stock and hour; only a positive start has one."""
    hours = F.col("interval_seconds") / 3600
    value = F.col("net_delta") / (F.when(F.col("count_before") > 0, F.col("count_before")) * hours)
    return rates.withColumn("relative_growth_per_hour", F.when(is_finite(value), value))


def latest_capture(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], time: str = "observed_at", tie: Sequence[str] = ()
) -> DataFrame:
    """The newest capture of every key as flat columns."""
    rest = [c for c in columns if c != time]
    return (
        df.groupBy(*keys)
        .agg(last_of([time, *rest], [time, *tie]))
        .select(*keys, F.col(f"last.{time}").alias(time), *[F.col(f"last.{c}").alias(c) for c in rest])
    )


def last_captures(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    n: int,
    time: str = "observed_at",
    tie: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The newest ``n`` captures of every key, numbered from the newest.

    Each stretch of a large key keeps its own newest ``n`` first, so no task ever ranks the
    whole history of one key.
    """
    from pyspark.sql import Window

    from .ordered import add_stretch

    newest = [F.col(time).desc(), *[F.col(t).desc() for t in tie]]
    kept = [*keys, time, *[t for t in tie if t not in keys]]
    kept += [c for c in columns if c not in kept]
    parted, cut = add_stretch(df.select(*kept), keys, time, hot_rows)
    if cut:
        inside = Window.partitionBy(*keys, "_part").orderBy(*newest)
        parted = parted.withColumn("_rank", F.row_number().over(inside)).filter(F.col("_rank") <= n)
        # Only the last stretches can matter: those whose later stretches hold fewer than n rows.
        sizes = parted.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
        after = (
            Window.partitionBy(*keys).orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
        )
        live = sizes.withColumn("_after", F.coalesce(F.sum("_c").over(after), F.lit(0))).filter(
            F.col("_after") < n
        )
        parted = parted.drop("_rank").join(live.select(*keys, "_part"), [*keys, "_part"], "left_semi")
    whole = Window.partitionBy(*keys).orderBy(*newest)
    return (
        parted.withColumn("recency", F.row_number().over(whole).cast("bigint"))
        .filter(F.col("recency") <= n)
        .drop("_part")
    )


def containment_counts(
    spans: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    time: str,
    span_seconds: int = 86_400,
) -> DataFrame:
    """Number of points with start < t <= end for every span.

    Points are counted per key and instant and summed up in time, cell by cell of ``span_seconds``;
    a span then is the difference of two nearest-before lookups, so the work is linear in spans and
    points for the busiest key too.
    """
    keys = list(keys)
    instants = points.filter(F.col(time).isNotNull()).groupBy(*keys, F.col(time).alias("_t")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    instants = instants.withColumn("_cell", F.floor(F.unix_micros("_t") / F.lit(1e6) / F.lit(span_seconds)))
    upto = running_position(instants, keys, "_cell", ["_t"], {"_before": "_n"}).select(
        *keys, "_t", (F.col("_before") + F.col("_n")).alias("_upto")
    )
    ends = F.array(
        F.struct(F.col(start).alias("_at"), F.lit(-1).alias("_sign")), F.struct(F.col(end).alias("_at"), F.lit(1).alias("_sign"))
    )
    sides = (
        spans.select(*keys, start, end)
        .filter(F.col(start).isNotNull() & F.col(end).isNotNull())
        .distinct()
        .select(*keys, start, end, F.explode(ends).alias("_e"))
        .select(*keys, start, end, "_e.*")
    )
    found = as_of(sides, upto, keys, "_at", "_t", ["_upto"])
    inside = F.sum(F.col("_sign") * F.coalesce("match._upto", F.lit(0)))
    hits = found.groupBy(*keys, start, end).agg(F.greatest(inside, F.lit(0)).alias("points_in_window"))
    return spans.join(hits, [*keys, start, end], "left").withColumn(
        "points_in_window", F.coalesce(F.col("points_in_window"), F.lit(0)).cast("bigint")
    )

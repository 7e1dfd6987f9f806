"""Set differences between follower snapshots, arrival quality, warnings and post feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.links import key_mode, member_key
from ..functions.numeric import safe_ratio, wilson
from ..functions.times import seconds_between
from .ordered import HOT_ROWS, as_of, with_previous

SNAPSHOT_COUNTERS = ("replies", "likes", "reposts", "bookmarks", "views")

# Warning names in report order.
WARNINGS = (
    "partial_lists",
    "incomplete_coverage",
    "collection_windows_overlap",
    "collection_start_missing",
    "verified_only_lists",
    "handle_only_identity",
    "quality_classification_incomplete",
    "unknown_badges",
)


def consecutive_pairs(snapshots: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pair every snapshot with the previous one of its account and scope.

    The output holds both sides' contract columns with ``before_`` and ``after_`` prefixes.
    """
    columns = ["snapshot_id", "observed_at", "collection_started_at", "scope", "complete", "quality_rubric"]
    base = snapshots.withColumn("_account", F.lower("account")).withColumn(
        "quality_rubric", F.coalesce(F.col("quality_rubric"), F.lit("public-v1"))
    )
    base = base.withColumn("_scope", F.coalesce("scope", F.lit("")))
    rows = with_previous(base, ["_account", "_scope"], "observed_at", columns, ["snapshot_id"], hot_rows)
    return rows.filter(F.col("prev").isNotNull()).select(
        "account",
        *[F.col(f"prev.{c}").alias(f"before_{c}") for c in columns],
        *[F.col(c).alias(f"after_{c}") for c in columns],
    )


def incomparable(pairs: DataFrame) -> DataFrame:
    """Pairs that must not be compared, with the reason."""
    reason = (
        F.when(F.col("before_scope") != F.col("after_scope"), "different_list_scopes")
        .when(F.col("before_quality_rubric") != F.col("after_quality_rubric"), "different_quality_rubrics")
        .when(F.col("after_observed_at") <= F.col("before_observed_at"), "after_must_be_later")
    )
    return pairs.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def pair_sides(pairs: DataFrame) -> DataFrame:
    """Two rows per pair: its earlier snapshot as side 0 and its later one as side 1."""
    sides = F.array(
        F.struct(
            F.col("before_snapshot_id").alias("snapshot_id"),
            F.lit(0).alias("_side"),
            F.col("before_observed_at").alias("_taken_at"),
        ),
        F.struct(
            F.col("after_snapshot_id").alias("snapshot_id"),
            F.lit(1).alias("_side"),
            F.col("after_observed_at").alias("_taken_at"),
        ),
    )
    ids = ["account", "before_snapshot_id", "after_snapshot_id"]
    return pairs.select(*ids, F.explode(sides).alias("_s")).select(*ids, "_s.*")


def member_changes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """One row per pair and identity with the badge on both sides and the kind of change.

    Every member row meets the one or two pairs of its snapshot and is grouped once on (pair,
    identity), so the comparison costs a single scan and shuffle and no outer join.
    """
    keyed = members.select(
        "snapshot_id",
        member_key(F.col("id"), F.col("handle")).alias("identity"),
        "badge",
        F.coalesce(F.col("quality_status"), F.lit("unknown")).alias("quality_status"),
    )
    rows = keyed.join(pair_sides(pairs), "snapshot_id")
    facts = F.struct("badge", "quality_status")
    both = (
        rows.groupBy("account", "before_snapshot_id", "after_snapshot_id", "identity")
        .agg(
            F.max(F.when(F.col("_side") == 0, facts)).alias("old"),
            F.max(F.when(F.col("_side") == 1, facts)).alias("new"),
        )
    )
    old, new = F.col("old.badge"), F.col("new.badge")
    stayed = F.col("old").isNotNull() & F.col("new").isNotNull()
    kind = (
        F.when(F.col("old").isNull() & (new == "blue"), "arrival")
        .when(F.col("new").isNull() & (old == "blue"), "departure")
        .when(stayed & (new == "blue") & ~old.isin("blue", "unknown"), "upgrade")
        .when(stayed & (old == "blue") & ~new.isin("blue", "unknown"), "downgrade")
        .when(
            stayed & (((old == "unknown") & (new == "blue")) | ((old == "blue") & (new == "unknown"))),
            "unresolved",
        )
    )
    return both.select(
        "account",
        "before_snapshot_id",
        "after_snapshot_id",
        "identity",
        old.alias("badge_before"),
        new.alias("badge_after"),
        F.col("new.quality_status").alias("quality_after"),
        kind.alias("change"),
    )


def key_coverage(changes: DataFrame) -> DataFrame:
    """Union, intersection and one-sided sizes of the identity sets of every pair."""
    old, new = F.col("badge_before").isNotNull(), F.col("badge_after").isNotNull()
    return changes.groupBy("account", "before_snapshot_id", "after_snapshot_id").agg(
        F.count(F.lit(1)).alias("n_union"),
        F.count_if(old & new).alias("n_both"),
        F.count_if(~old).alias("n_only_after"),
        F.count_if(~new).alias("n_only_before"),
    )


def arrival_summary(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """Counts, shares, bounds and gates of every pair; unknown quality stays in the denominator."""
    keys = ["account", "before_snapshot_id", "after_snapshot_id"]
    kind, quality = F.col("change"), F.col("quality_after")
    arrival = kind == "arrival"
    totals = changes.groupBy(*keys).agg(
        F.count_if(arrival).alias("n"),
        F.count_if(arrival & (quality == "high")).alias("high"),
        F.count_if(arrival & (quality == "unknown")).alias("unknown"),
        F.count_if(kind == "departure").alias("departures"),
        F.count_if(kind == "upgrade").alias("upgrades"),
        F.count_if(kind == "downgrade").alias("downgrades"),
        F.count_if(kind == "unresolved").alias("unresolved"),
        F.count_if(F.col("badge_before") == "blue").alias("old_blue"),
        F.count_if(F.col("badge_after") == "blue").alias("new_blue"),
        F.count_if((F.col("badge_before") == "unknown") | (F.col("badge_after") == "unknown")).alias("unknown_badges"),
        F.min(key_mode(F.col("identity"))).alias("_mode_low"),
        F.max(key_mode(F.col("identity"))).alias("_mode_high"),
    )
    joined = pairs.join(totals, keys, "left").fillna(
        0,
        [
            "n", "high", "unknown", "departures", "upgrades", "downgrades", "unresolved",
            "old_blue", "new_blue", "unknown_badges",
        ],
    )
    mixed = F.coalesce(F.col("_mode_low") != F.col("_mode_high"), F.lit(False))
    overlap = F.coalesce(F.col("after_collection_started_at"), F.col("after_observed_at")) < F.col(
        "before_observed_at"
    )
    both_complete = F.col("before_complete") & F.col("after_complete")
    covered = both_complete & ~overlap
    exact = (
        covered
        & (F.col("before_scope") == "all_followers")
        & F.coalesce((F.col("_mode_low") == "id") & (F.col("_mode_high") == "id"), F.lit(True))
    )
    timed = F.col("before_collection_started_at").isNotNull() & F.col("after_collection_started_at").isNotNull()
    rows = (
        joined.withColumn("mixed_identity_modes", mixed)
        .withColumn("overlapping", overlap)
        .withColumn("coverage_complete", covered)
        .withColumn("exact", exact)
        .withColumn("_timed", timed)
        .withColumn("_partial", ~both_complete)
    )
    n, high, unknown = F.col("n"), F.col("high"), F.col("unknown")
    exact = F.col("exact")
    share = safe_ratio(high, n)
    low, top = wilson(high, n)
    settled = exact & (unknown == 0)
    full = exact & (F.col("unknown_badges") == 0) & (unknown == 0) & F.col("_timed")
    warnings = F.filter(
        F.array(
            F.when(F.col("_partial"), WARNINGS[0]),
            F.when(~F.col("coverage_complete"), WARNINGS[1]),
            F.when(F.col("overlapping"), WARNINGS[2]),
            F.when((n > 0) & ~F.col("_timed"), WARNINGS[3]),
            F.when(F.col("before_scope") == "verified_followers", WARNINGS[4]),
            F.when((F.col("_mode_low") == "handle") | (F.col("_mode_high") == "handle"), WARNINGS[5]),
            F.when(unknown > 0, WARNINGS[6]),
            F.when(F.col("unresolved") > 0, WARNINGS[7]),
        ),
        lambda w: w.isNotNull(),
    )
    return rows.select(
        *keys,
        F.col("before_observed_at").alias("from_at"),
        F.col("after_observed_at").alias("to_at"),
        F.col("after_scope").alias("scope"),
        "mixed_identity_modes",
        exact.alias("exact_follower_comparison"),
        F.when(exact, n).alias("confirmed_new_blue"),
        n.alias("observed_blue_arrivals"),
        F.when(exact, F.col("departures")).alias("confirmed_blue_follower_departures"),
        F.col("departures").alias("observed_blue_departures"),
        F.col("upgrades").alias("existing_became_blue"),
        F.col("downgrades").alias("existing_no_longer_blue"),
        F.col("unresolved").alias("unresolved_existing_badge_transitions"),
        F.when(exact & (F.col("unknown_badges") == 0), F.col("new_blue") - F.col("old_blue")).alias(
            "blue_membership_net"
        ),
        F.when(exact, high).alias("confirmed_high_quality_new_blue"),
        high.alias("observed_high_quality_arrivals"),
        unknown.alias("unknown_quality_arrivals"),
        (unknown == 0).alias("quality_classification_complete"),
        F.when(n == 0, "undefined").when(unknown > 0, "lower_bound").otherwise("complete").alias("quality_share_status"),
        share.alias("quality_share"),
        F.when(exact, "confirmed_new_blue").otherwise("observed_arrivals_only").alias("quality_share_kind"),
        "coverage_complete",
        F.when(full, share).alias("full_window_quality_share"),
        share.alias("quality_lower"),
        safe_ratio(high + unknown, n).alias("quality_upper"),
        F.when(settled, low).alias("wilson_low"),
        F.when(settled, top).alias("wilson_high"),
        warnings.alias("warnings"),
    )


def warning_rows(summary: DataFrame) -> DataFrame:
    keys = ["account", "before_snapshot_id", "after_snapshot_id"]
    return summary.select(*keys, F.explode("warnings").alias("warning"))


def post_feedback(
    pairs: DataFrame, posts: DataFrame, counters: Sequence[str] = SNAPSHOT_COUNTERS
) -> DataFrame:
    """Counter deltas of every post seen on either side of a pair, each with a reason when null."""
    keys = ["account", "before_snapshot_id", "after_snapshot_id"]
    sides = pair_sides(pairs)
    rows = posts.select("snapshot_id", "url", "post_id", "post_observed_at", *counters).join(sides, "snapshot_id")
    rows = rows.withColumn("_at", F.coalesce(F.col("post_observed_at"), F.col("_taken_at")))
    facts = F.struct("url", "_at", *counters)
    both = rows.groupBy(*keys, "post_id").agg(
        F.max(F.when(F.col("_side") == 0, facts)).alias("old"),
        F.max(F.when(F.col("_side") == 1, facts)).alias("new"),
    )
    advanced = seconds_between(F.col("old._at"), F.col("new._at")) > 0
    out = [
        *keys,
        "post_id",
        F.coalesce(F.col("new.url"), F.col("old.url")).alias("url"),
        F.col("old._at").alias("window_from"),
        F.col("new._at").alias("window_to"),
    ]
    for c in counters:
        b, a = F.col(f"old.{c}"), F.col(f"new.{c}")
        reason = (
            F.when(a.isNull() | b.isNull(), "unavailable or missing baseline")
            .when(~advanced, "post observation time did not advance")
            .when(a < b, "counter decreased; reconcile observations")
        )
        out += [F.when(reason.isNull(), a - b).alias(f"{c}_delta"), reason.alias(f"{c}_reason")]
    return both.select(*out)


def retention(
    cohort: DataFrame,
    snapshots: DataFrame,
    members: DataFrame,
    deadline_hours: float,
) -> DataFrame:
    """Share of the frozen cohort of stable ids still present at the first complete list at or
    after the deadline; null with a reason when no complete later list exists.

    ``cohort`` holds account, id and cohort_at; ``members`` holds snapshot_id and id.
    """
    size = cohort.groupBy("account", "cohort_at").agg(F.count_distinct("id").alias("n_initial"))
    later = snapshots.filter(F.col("complete") & (F.col("scope") == "all_followers")).select(
        "account", "snapshot_id", F.col("observed_at").alias("checked_at")
    )
    due = size.withColumn(
        "due_at", F.timestamp_micros(F.unix_micros("cohort_at") + F.lit(int(deadline_hours * 3_600_000_000)))
    )
    chosen = (
        as_of(due, later, ["account"], "due_at", "checked_at", ["snapshot_id"], forward=True)
        .filter(F.col("match").isNotNull())
        .select("account", "cohort_at", "match.checked_at", "match.snapshot_id")
    )
    present = (
        cohort.select("account", "cohort_at", "id")
        .distinct()
        .join(chosen, ["account", "cohort_at"])
        .join(members.select("snapshot_id", "id").distinct(), ["snapshot_id", "id"])
        .groupBy("account", "cohort_at")
        .agg(F.count(F.lit(1)).alias("n_kept"))
    )
    return (
        size.join(chosen, ["account", "cohort_at"], "left")
        .join(present, ["account", "cohort_at"], "left")
        .withColumn(
            "n_retained",
            F.when(F.col("checked_at").isNotNull(), F.coalesce(F.col("n_kept"), F.lit(0))),
        )
        .select(
            "account",
            "cohort_at",
            "n_initial",
            "checked_at",
            "n_retained",
            safe_ratio(F.col("n_retained"), F.col("n_initial")).alias("retention"),
            F.when(F.col("checked_at").isNull(), "no_complete_later_list").alias("reason"),
        )
    )


def stock_density(snapshots: DataFrame, members: DataFrame) -> DataFrame:
    """High-quality blue members over all members of complete lists, with classification bounds."""
    blue = F.col("badge") == "blue"
    counts = members.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.count_if(blue & (F.col("quality_status") == "high")).alias("high"),
        F.count_if(blue & (F.coalesce(F.col("quality_status"), F.lit("unknown")) == "unknown")).alias("unknown"),
        F.count_if(F.col("badge") == "unknown").alias("unknown_badges"),
    )
    usable = F.col("complete") & (F.col("scope") == "all_followers") & (F.col("unknown_badges") == 0)
    return snapshots.join(counts, "snapshot_id").select(
        "account",
        "snapshot_id",
        "n_members",
        "high",
        "unknown",
        F.when(usable, safe_ratio(F.col("high"), F.col("n_members"))).alias("density_lower"),
        F.when(usable, safe_ratio(F.col("high") + F.col("unknown"), F.col("n_members"))).alias("density_upper"),
    )

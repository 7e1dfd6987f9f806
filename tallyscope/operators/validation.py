"""Named rules over columns and groups; failing rows go to a quarantine table with the rule name.

A rule's column is true for a bad row. ``split`` keeps every row: good ones unchanged, bad ones
with the first failing rule. ``require`` is the strict mode that raises instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import links, numeric
from .ordered import HOT_ROWS, with_previous


@dataclass(frozen=True)
class Rule:
    name: str
    bad: Column


def failing_rule(rules: Sequence[Rule]) -> Column:
    """Name of the first failing rule, or null. An undecidable rule does not fail a row."""
    return F.coalesce(*[F.when(F.coalesce(r.bad, F.lit(False)), F.lit(r.name)) for r in rules])


def split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    tagged = df.withColumn("rule", failing_rule(rules))
    return tagged.filter(F.col("rule").isNull()).drop("rule"), tagged.filter(F.col("rule").isNotNull())


def as_quarantine(bad: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """The common quarantine layout: table, key, rule and the row as JSON detail."""
    rest = [c for c in bad.columns if c != "rule"]
    return bad.select(
        F.lit(table).alias("table"),
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
        "rule",
        F.to_json(F.struct(*rest)).alias("detail"),
    )


def require(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Strict mode: the first bad row stops the job with the name of its rule."""
    ok, bad = split(df, rules)
    sample = bad.select("rule").head()
    if sample is not None:
        raise ValueError(f"rejected input: {sample[0]}")
    return ok


def require_empty(violations: DataFrame, message: str) -> None:
    if not violations.isEmpty():
        raise ValueError(message)


# --- values -----------------------------------------------------------------------------------


def count_rule(column: str, nullable: bool = True) -> Rule:
    c = F.col(column)
    bad = (c < 0) if nullable else (c.isNull() | (c < 0))
    return Rule(f"{column}_not_a_count", bad)


def finite_rule(column: str, nonnegative: bool = True) -> Rule:
    c = F.col(column)
    bad = c.isNull() | ~numeric.is_finite(c)
    return Rule(f"{column}_not_finite", bad | (c < 0) if nonnegative else bad)


def enum_rule(column: str, allowed: Sequence[str]) -> Rule:
    c = F.col(column)
    return Rule(f"{column}_not_allowed", c.isNull() | ~c.isin(*allowed))


# --- order and repeats ------------------------------------------------------------------------


def out_of_order(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    time: str = "observed_at",
    allow_equal: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Timed rows whose clock does not move forward in declared order."""
    timed = df.filter(F.col(time).isNotNull())
    rows = with_previous(timed, keys, index, [time], (), hot_rows)
    late = F.col(time) < F.col(f"prev.{time}")
    if not allow_equal:
        late = late | (F.col(time) == F.col(f"prev.{time}"))
    return rows.filter(late).drop("prev")


def capture_conflicts(
    df: DataFrame, keys: Sequence[str], counters: Sequence[str], time: str = "observed_at"
) -> DataFrame:
    """Repeated captures of one key and instant: identical ones collapse, different ones conflict."""
    facts = F.struct(*counters)
    return df.groupBy(*keys, time).agg(
        F.count(F.lit(1)).alias("n_captures"),
        F.min(facts).alias("_low"),
        F.max(facts).alias("_high"),
    ).select(
        *keys,
        time,
        "n_captures",
        F.when(F.col("_low") != F.col("_high"), "conflict")
        .when(F.col("n_captures") > 1, "duplicate_identical_counter_snapshot")
        .otherwise("single")
        .alias("capture_status"),
    )


def dedupe_captures(
    df: DataFrame, keys: Sequence[str], counters: Sequence[str], time: str = "observed_at"
) -> tuple[DataFrame, DataFrame]:
    """(one row per key and instant, conflicting captures)."""
    facts = F.struct(*counters)
    others = [c for c in df.columns if c not in {*keys, time, *counters}]
    grouped = df.groupBy(*keys, time).agg(
        F.count(F.lit(1)).alias("n_captures"),
        F.min(facts).alias("_low"),
        F.max(facts).alias("_high"),
        *[F.min(c).alias(c) for c in others],
    )
    same = grouped.filter(F.col("_low") == F.col("_high")).select(
        *keys, time, *[F.col(f"_low.{c}").alias(c) for c in counters], *others
    )
    conflict = grouped.filter(F.col("_low") != F.col("_high")).select(*keys, time, "n_captures")
    return same, conflict


def publication_conflicts(df: DataFrame, key: str, published: str = "published_at") -> DataFrame:
    """Keys that carry more than one publication time."""
    return (
        df.groupBy(key)
        .agg(F.min(published).alias("_a"), F.max(published).alias("_b"))
        .filter(F.col("_a") != F.col("_b"))
        .select(key)
    )


def observed_before_publication(
    df: DataFrame, published: str = "published_at", time: str = "observed_at"
) -> Rule:
    return Rule("observed_before_publication", F.col(time) < F.col(published))


# --- snapshots --------------------------------------------------------------------------------

# Fixed values of the snapshot contract.
SCOPES = ("all_followers", "verified_followers")
BADGES = ("blue", "gold", "gray", "none", "unknown")
QUALITIES = ("high", "not_high", "unknown")


def snapshot_rules() -> list[Rule]:
    return [
        Rule("account_required", F.col("account").isNull() | (F.col("account") == "")),
        Rule("observed_at_required", F.col("observed_at").isNull()),
        Rule("collection_starts_after_observation", F.col("collection_started_at") > F.col("observed_at")),
        enum_rule("scope", SCOPES),
        Rule("complete_must_be_boolean", F.col("complete").isNull()),
        Rule("complete_without_evidence", F.col("complete") & (F.coalesce(F.col("evidence"), F.lit("")) == "")),
        count_rule("total_followers"),
        Rule(
            "complete_total_mismatch",
            F.col("complete")
            & (F.col("scope") == "all_followers")
            & ~F.col("total_followers").eqNullSafe(F.size("followers").cast("bigint")),
        ),
    ]


def member_rules() -> list[Rule]:
    """Rules over exploded members with columns id, handle, badge, quality."""
    q = F.col("quality")
    all_three = (
        q["relevant"].eqNullSafe(F.lit(True))
        & q["original"].eqNullSafe(F.lit(True))
        & q["substantive"].eqNullSafe(F.lit(True))
    )
    evidence = F.coalesce(q["evidence"], F.array().cast("array<string>"))
    shown = (F.size(evidence) > 0) & F.forall(
        evidence,
        lambda u: F.coalesce(
            u.startswith(links.EVIDENCE_PREFIXES[0]) | u.startswith(links.EVIDENCE_PREFIXES[1]), F.lit(False)
        ),
    )
    high = q["status"] == "high"
    return [
        Rule("invalid_handle", F.col("handle").isNull() | ~F.col("handle").rlike(links.HANDLE)),
        Rule("invalid_id", F.col("id").isNotNull() & ~F.col("id").rlike(links.CANONICAL_ID)),
        enum_rule("badge", BADGES),
        Rule("quality_status_not_allowed", q.isNotNull() & ~F.coalesce(q["status"].isin(*QUALITIES), F.lit(False))),
        Rule("high_without_three_criteria", high & ~all_three),
        Rule("high_without_public_evidence", high & ~shown),
    ]


def repeated_members(members: DataFrame, snapshot: str = "snapshot_id") -> DataFrame:
    """Handles (case-folded) or ids that occur more than once in one snapshot."""
    handles = members.groupBy(snapshot, F.lower("handle").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ids = members.filter(F.col("id").isNotNull()).groupBy(snapshot, F.col("id").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        handles.withColumn("rule", F.lit("duplicate_handle"))
        .unionByName(ids.withColumn("rule", F.lit("duplicate_id")))
        .filter(F.col("n") > 1)
    )


def post_rules(counters: Sequence[str]) -> list[Rule]:
    """Rules over exploded snapshot posts with url, post_id, post_observed_at and the snapshot clock."""
    return [
        Rule("invalid_permalink", F.col("post_id").isNull()),
        Rule("post_after_snapshot", F.col("post_observed_at") > F.col("observed_at")),
        *[count_rule(c) for c in counters],
    ]


def repeated_posts(posts: DataFrame, snapshot: str = "snapshot_id") -> DataFrame:
    """Posts named twice in one snapshot through permalink aliases."""
    return (
        posts.filter(F.col("post_id").isNotNull())
        .groupBy(snapshot, "post_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


# --- cohorts, targets, documents --------------------------------------------------------------


def cohort_rules(prefix: str = "") -> list[Rule]:
    def c(name: str) -> Column:
        return F.col(prefix + name)

    n, high, other, unknown = c("observed_arrivals"), c("high"), c("not_high"), c("unknown")
    missing = n.isNull() | high.isNull() | other.isNull() | unknown.isNull()
    return [
        Rule("cohort_count_missing", missing),
        Rule("cohort_count_negative", F.least(n, high, other, unknown) < 0),
        Rule("cohort_partition", high + other + unknown != n),
        Rule("confirmed_exceeds_arrivals", c("confirmed_new_followers") > n),
        Rule("confirmed_negative", c("confirmed_new_followers") < 0),
        Rule("cohort_window_reversed", c("window_started_at") > c("window_ended_at")),
    ]


def rolling_rules(source: str, window_days: int = 90) -> list[Rule]:
    """Rolling eligibility counter joined to its targets."""
    return [
        Rule("window_days", ~F.col("window_days").eqNullSafe(F.lit(window_days))),
        Rule("several_targets", F.col("n_targets") > 1),
        Rule(
            "target_not_positive",
            ~F.coalesce((F.col("impression_target") >= 1) & (F.col("verified_follower_target") >= 1), F.lit(False)),
        ),
        Rule("source", ~F.col("source").eqNullSafe(F.lit(source))),
        Rule("replies_must_be_excluded", ~F.col("replies_excluded").eqNullSafe(F.lit(True))),
        Rule("observed_at_required", F.col("observed_at").isNull()),
        count_rule("verified_home_impressions_90d", nullable=False),
        count_rule("verified_followers", nullable=False),
        count_rule("payout_qualified_impressions"),
    ]


def metrics_document_rules() -> list[Rule]:
    """Document-level rules; the exploded collections carry their own."""
    account = F.col("account")
    return [
        Rule("invalid_account", account.isNull() | ~account.rlike(links.HANDLE)),
        Rule("follower_observations_required", F.col("follower_observations").isNull()),
        Rule("blue_observations_required", F.col("blue_observations").isNull()),
        Rule("posts_required", F.col("posts").isNull()),
        Rule("cohort_required", F.col("blue_cohort").isNull()),
        *cohort_rules("blue_cohort."),
        Rule(
            "launch_post_owner",
            F.col("launch_post").isNotNull() & ~links.belongs_to(F.col("launch_post"), account),
        ),
        Rule("github_required", F.col("github").isNull()),
        Rule(
            "github_counters_with_clock",
            F.col("github.observed_at").isNotNull()
            & (F.col("github.stars").isNull() | F.col("github.forks").isNull()),
        ),
        Rule("github_counter_negative", (F.col("github.stars") < 0) | (F.col("github.forks") < 0)),
    ]


def owned_post_rule(column: str = "url") -> Rule:
    return Rule(f"{column}_not_owned", ~F.coalesce(links.belongs_to(F.col(column), F.col("account")), F.lit(False)))


def attribution(
    row_url: Column, observed_at: Column, value: Column, proof: Column
) -> tuple[Column, Column, Column]:
    """(attributed follows, reason it is missing, broken-evidence flag)."""
    present = proof.isNotNull()
    documented = proof["official_metric_documentation"].rlike(r"^https://(help|business)\.x\.com/[^\s]+\z")
    broken = present & value.isNotNull() & ~F.coalesce(
        (proof["source"] == "owner_analytics")
        & (proof["field"] == "follows_attributed")
        & (links.post_id(proof["url"]) == links.post_id(row_url))
        & (proof["observed_at"] == observed_at)
        & documented
        & (F.trim(proof["capture_evidence"]) != ""),
        F.lit(False),
    )
    reason = F.when(value.isNull(), "not_measured").when(~present, "attribution_evidence_missing").when(
        broken, "attribution_evidence_invalid"
    )
    return F.when(reason.isNull(), value), reason, broken


# --- cascade tables ---------------------------------------------------------------------------

CUTOFFS = (900, 3600)


def feature_row_rules() -> list[Rule]:
    cutoff, observed = F.col("cutoff_seconds"), F.col("observed_retweet_count")
    first, last = F.col("first_observed_retweet_seconds"), F.col("last_observed_retweet_seconds")
    future, total = F.col("future_retweets_to_24h"), F.col("total_retweets_at_24h")
    day = F.col("post_time_day")
    paper = F.when(day < 7, "train_candidate").otherwise("evaluation_candidate")
    strict = (
        F.when(day + 1 <= 7, "train_candidate").when(day < 7, "purged_label_overlap").otherwise("evaluation_candidate")
    )
    return [
        Rule("invalid_cascade_id", ~F.coalesce(F.col("cascade_id").rlike(r"^cascade-[0-9]{6,}\z"), F.lit(False))),
        Rule("day_outside_coverage", day.isNull() | F.isnan(day) | ~((day >= 0) & (day < 15))),
        Rule(
            "split_mismatch",
            ~F.col("strict_label_available_split").eqNullSafe(strict) | ~F.col("paper_day_split").eqNullSafe(paper),
        ),
        Rule("label_day_mismatch", F.col("label_available_day").isNull() | (F.abs(F.col("label_available_day") - (day + 1)) > 1e-10)),
        Rule("invalid_cutoff", cutoff.isNull() | ~cutoff.isin(*CUTOFFS)),
        Rule("invalid_count", observed.isNull() | future.isNull() | total.isNull() | (F.least(observed, future, total) < 0)),
        Rule("cold_with_times", (observed == 0) & (first.isNotNull() | last.isNotNull())),
        Rule("warm_without_times", (observed > 0) & (first.isNull() | last.isNull())),
        Rule("times_outside_cutoff", (observed > 0) & ~((first >= 0) & (first <= last) & (last <= cutoff))),
        Rule("single_event_two_times", (observed == 1) & (first != last)),
        Rule("total_mismatch", total != observed + future),
    ]


def paired_cutoffs(features: DataFrame) -> DataFrame:
    """One row per cascade with both cutoffs side by side, and the first broken pair rule."""
    def side(cutoff: int) -> Column:
        return F.max(
            F.when(
                F.col("cutoff_seconds") == cutoff,
                F.struct(
                    "post_time_day",
                    "strict_label_available_split",
                    F.col("observed_retweet_count").alias("observed"),
                    F.col("first_observed_retweet_seconds").alias("first_at"),
                    F.col("last_observed_retweet_seconds").alias("last_at"),
                    F.col("total_retweets_at_24h").alias("total"),
                ),
            )
        )

    pairs = features.groupBy("cascade_id").agg(
        F.count(F.lit(1)).alias("n_rows"), side(900).alias("early"), side(3600).alias("late")
    )
    e, late = F.col("early"), F.col("late")
    rules = [
        Rule("cutoff_missing", e.isNull() | late.isNull()),
        Rule("cutoff_repeated", F.col("n_rows") != 2),
        Rule(
            "metadata_mismatch",
            (e["post_time_day"] != late["post_time_day"])
            | (e["strict_label_available_split"] != late["strict_label_available_split"])
            | (e["total"] != late["total"]),
        ),
        Rule("observed_decreased", e["observed"] > late["observed"]),
        Rule("cold_then_early_event", (e["observed"] == 0) & (late["observed"] > 0) & (late["first_at"] <= 900)),
        Rule("new_event_before_cutoff", (late["observed"] > e["observed"]) & (late["last_at"] <= 900)),
        Rule(
            "history_inconsistent",
            (e["observed"] > 0) & ((e["first_at"] != late["first_at"]) | (e["last_at"] > late["last_at"])),
        ),
        Rule(
            "unchanged_count_new_times",
            (e["observed"] == late["observed"])
            & ~(e["first_at"].eqNullSafe(late["first_at"]) & e["last_at"].eqNullSafe(late["last_at"])),
        ),
    ]
    return pairs.withColumn("rule", failing_rule(rules))


def equal_sample_guard(summaries: DataFrame, keys: Sequence[str] = ("source", "horizon_bucket")) -> DataFrame:
    """Groups whose models were scored on the same number of predictions and posts."""
    sample = F.struct("n_predictions", "n_posts")
    return (
        summaries.groupBy(*keys)
        .agg(F.min(sample).alias("_a"), F.max(sample).alias("_b"), F.count(F.lit(1)).alias("n_models"))
        .select(*keys, "n_models", (F.col("_a") == F.col("_b")).alias("equal_samples"))
    )

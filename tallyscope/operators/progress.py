"""Progress of rolling eligibility counters towards fixed targets, and update planning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import coverage_label, safe_ratio
from ..functions.times import seconds_between, utc_text
from .ordered import HOT_ROWS, as_of, last_of, with_previous


TARGETS = ("impression_target", "verified_follower_target")


def with_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with the targets of their own key: the columns both tables share, or one row for all.

    ``n_targets`` says how many target rows the key has; more than one leaves it undecided which
    holds, so validation refuses those rows.
    """
    on = [c for c in targets.columns if c in rows.columns and c not in TARGETS]
    one = targets.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n_targets"), *[F.min(c).alias(c) for c in targets.columns if c not in on]
    )
    # Without a shared column there is exactly one aggregated row.
    return rows.join(one, on, "left") if on else rows.join(F.broadcast(one), F.lit(True), "left")


def progress_latest(observations: DataFrame, keys: Sequence[str], targets: DataFrame) -> DataFrame:
    """Latest capture of every key against the target row of its metric."""
    shared = [c for c in targets.columns if c in observations.columns and c not in keys and c not in TARGETS]
    latest = observations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observation_count"),
        last_of(["observed_at", "verified_home_impressions_90d", "verified_followers", *shared], ["observed_at"]),
    )
    latest = latest.withColumns({c: F.col(f"last.{c}") for c in shared})
    home, followers = F.col("last.verified_home_impressions_90d"), F.col("last.verified_followers")
    goal, follower_goal = F.col("impression_target"), F.col("verified_follower_target")
    return with_targets(latest, targets).select(
        *keys,
        "observation_count",
        F.when(F.col("observation_count") > 1, "measured_rolling_net_changes")
        .otherwise("measured_baseline_only")
        .alias("status"),
        F.col("last.observed_at").alias("observed_at"),
        home.alias("verified_home_impressions_90d"),
        followers.alias("verified_followers"),
        F.greatest(F.lit(0), goal - home).alias("impression_deficit"),
        F.greatest(F.lit(0), follower_goal - followers).alias("verified_follower_deficit"),
        safe_ratio(home, goal).alias("impression_progress_fraction"),
        safe_ratio(followers, follower_goal).alias("verified_follower_progress_fraction"),
        (home >= goal).alias("impression_threshold_met"),
        (followers >= follower_goal).alias("verified_follower_threshold_met"),
        ((home >= goal) & (followers >= follower_goal)).alias("both_thresholds_met"),
    )


def progress_intervals(observations: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Net changes between captures; a rolling counter may fall when old exposure expires."""
    fields = ["verified_home_impressions_90d", "verified_followers"]
    rows = with_previous(observations, keys, "observed_at", fields, (), hot_rows).filter(
        F.col("prev").isNotNull()
    )
    seconds = seconds_between(F.col("prev.observed_at"), F.col("observed_at"))
    home = F.col(fields[0]) - F.col(f"prev.{fields[0]}")
    followers = F.col(fields[1]) - F.col(f"prev.{fields[1]}")
    return rows.select(
        *keys,
        F.col("prev.observed_at").alias("started_at"),
        F.col("observed_at").alias("ended_at"),
        seconds.alias("interval_seconds"),
        home.alias("rolling_net_impression_delta"),
        safe_ratio(home, seconds).alias("rolling_net_impressions_per_second"),
        safe_ratio(home * 3600, seconds).alias("rolling_net_impressions_per_hour"),
        F.when(home < 0, "rolling_net_decline_possible_expiry")
        .when(home > 0, "rolling_net_increase")
        .otherwise("rolling_net_unchanged")
        .alias("impression_change_status"),
        followers.alias("verified_follower_net_delta"),
        safe_ratio(followers, seconds).alias("verified_followers_net_per_second"),
        safe_ratio(followers * 3600, seconds).alias("verified_followers_net_per_hour"),
    )


def clean_changes(changes: Column) -> Column:
    """Distinct trimmed non-empty change notes in order."""
    return F.array_sort(
        F.array_distinct(F.filter(F.transform(changes, lambda c: F.trim(c)), lambda c: c != ""))
    )


# Material fields in fingerprint (sorted) order.
MATERIAL = ("account", "changes", "launch_post", "observed_blue_count", "quality", "quality_rubric", "total_followers")
# Fields in declared report order.
REPORT_ORDER = ("account", "launch_post", "total_followers", "observed_blue_count", "quality", "quality_rubric", "changes")


def fingerprint(fields: Sequence[str] = MATERIAL) -> Column:
    """Digest of the material fields as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)


def material_state(
    accounts: DataFrame, followers: DataFrame, blues: DataFrame, cohorts: DataFrame
) -> DataFrame:
    """Current material facts per account with the clock of every part.

    ``accounts`` carries account, launch_post, quality_rubric and changes (array of text).
    """
    total = followers.filter(F.col("observed_at").isNotNull()).groupBy("account").agg(
        F.max("observed_at").alias("followers_at"),
        F.max_by("total", F.struct("observed_at", "total")).alias("total_followers"),
    )
    blue = blues.filter(F.col("observed_at").isNotNull()).groupBy("account").agg(
        F.max("observed_at").alias("blue_at"),
        F.max_by("count", F.struct("observed_at", "count")).alias("observed_blue_count"),
    )
    quality = F.struct("confirmed_new_followers", "high", "not_high", "observed_arrivals", "unknown")
    cohort = cohorts.select(
        "account",
        quality.alias("quality"),
        F.coalesce(F.col("classified_at"), F.col("window_ended_at")).alias("quality_at"),
        F.col("window_ended_at").alias("cohort_window_at"),
    )
    return (
        accounts.withColumn("changes", clean_changes(F.col("changes")))
        .join(total, "account")
        .join(blue, "account", "left")
        .join(cohort, "account")
        .withColumn("fingerprint", fingerprint())
    )


def plan_updates(
    current: DataFrame, published: DataFrame, now: Column, min_interval_minutes: int = 60
) -> DataFrame:
    """Which accounts have a material change that is due, and which fields changed.

    ``published`` holds the last published state per account: the material fields, the four
    observation clocks with a ``_at`` suffix, and verified_at.
    """
    clocks = ["followers_at", "blue_at", "quality_at", "cohort_window_at"]
    last = published.select(
        "account", F.struct(*REPORT_ORDER[1:], *clocks, "verified_at").alias("last")
    )
    rows = current.join(last, "account", "left")
    changed = []
    for field in REPORT_ORDER:
        before = F.col("account") if field == "account" else F.col(f"last.{field}")
        differs = F.col("last").isNull() | ~F.col(field).eqNullSafe(before)
        if field == "changes":
            # Notes announced earlier need not be repeated.
            differs = differs & (F.col("last").isNull() | (F.size(field) > 0))
        changed.append(F.when(differs, field))
    regressed = F.lit(False)
    for clock in clocks:
        regressed = regressed | (
            F.col(f"last.{clock}").isNotNull() & (F.col(clock).isNull() | (F.col(clock) < F.col(f"last.{clock}")))
        )
    due = F.timestamp_micros(F.unix_micros("last.verified_at") + F.lit(min_interval_minutes * 60_000_000))
    rows = (
        rows.withColumn("changed_fields", F.filter(F.array(*changed), lambda c: c.isNotNull()))
        .withColumn("clock_regressed", F.coalesce(regressed, F.lit(False)))
        .withColumn(
            "foreign_state",
            F.coalesce(F.col("launch_post") != F.col("last.launch_post"), F.lit(False)),
        )
        .withColumn("not_before", F.when(now < due, due))
    )
    has = F.size("changed_fields") > 0
    valid = ~F.col("clock_regressed") & ~F.col("foreign_state")
    act = has & F.col("not_before").isNull() & valid
    return rows.select(
        "account",
        act.alias("should_update"),
        F.when(F.col("foreign_state"), "state_of_another_entrance")
        .when(F.col("clock_regressed"), "observation_older_than_published")
        .when(act, "material_change")
        .when(has, "operating_interval")
        .otherwise("no_material_change")
        .alias("reason"),
        "changed_fields",
        "not_before",
        "fingerprint",
    )


def legacy_baseline(updates: DataFrame, followers: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Total reported by the newest earlier update: latest follower row at or before its clock."""
    newest = updates.filter(F.col("reported_at").isNotNull()).groupBy("account").agg(
        F.max("reported_at").alias("reported_at"),
        F.max_by("verified_at", F.struct("reported_at", "verified_at")).alias("verified_at"),
    )
    found = as_of(newest, followers, ["account"], "reported_at", "observed_at", ["total"], False, hot_rows)
    return found.filter(F.col("match").isNotNull()).select(
        "account",
        "reported_at",
        "verified_at",
        F.col("match.observed_at").alias("baseline_at"),
        F.col("match.total").alias("total_followers"),
    )


def record_publication(history: DataFrame, plans: DataFrame, evidence: DataFrame) -> DataFrame:
    """Accepted publication rows: confirmed in a browser, newer than the last one, no repeats."""
    last = history.groupBy("account").agg(
        F.max("verified_at").alias("last_verified_at"),
        F.max_by("fingerprint", "verified_at").alias("last_fingerprint"),
    )
    ok_method = ((F.col("method") == "edit") & (F.col("url") == F.col("launch_post"))) | (
        (F.col("method") == "thread_reply")
        & (F.col("parent") == F.col("launch_post"))
        & (F.col("url") != F.col("launch_post"))
    )
    rows = plans.filter("should_update").join(evidence, "account").join(last, "account", "left")
    fresh = F.col("last_verified_at").isNull() | (
        (F.col("verified_at") > F.col("last_verified_at"))
        & (F.col("planned_at") > F.col("last_verified_at"))
        & (F.col("fingerprint") != F.col("last_fingerprint"))
    )
    return rows.filter(
        (F.col("confirmed") == F.lit(True))
        & (F.col("evidence_source") == "browser")
        & ok_method
        & (F.col("verified_at") >= F.col("planned_at"))
        & (F.trim("observation") != "")
        & fresh
    ).select("account", "fingerprint", "verified_at", "url", "method")


def headline_rows(
    followers: DataFrame, cohorts: DataFrame, blues: DataFrame
) -> DataFrame:
    """Headline metric and value rows per account, as a long table."""
    span = followers.groupBy("account").agg(
        F.min_by(F.struct("observed_at", "total"), F.struct("index")).alias("a"),
        F.max_by(F.struct("observed_at", "total"), F.struct("index")).alias("b"),
    )
    blue = blues.groupBy("account").agg(F.max("observed_at").alias("blue_at"))
    rows = cohorts.join(span, "account", "left").join(blue, "account", "left")
    n = F.col("observed_arrivals")

    def show(value: Column, missing: str) -> Column:
        return F.coalesce(value.cast("string"), F.lit(missing))

    def percent(part: Column) -> Column:
        # Tenths of a percent from integers, halves up, so every engine writes the same digits.
        tenths = F.floor((2000 * part + n) / (2 * n)).cast("bigint")
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))

    share = F.when((n > 0) & (F.col("unknown") == 0), percent(F.col("high")))
    bounds = F.when(n > 0, F.concat(percent(F.col("high")), F.lit("-"), percent(F.col("high") + F.col("unknown"))))
    stamp = "Timestamp unavailable"
    values = {
        "total_followers": F.when(
            F.col("a").isNotNull(),
            F.format_string(
                "%d -> %d (%+d)", F.col("a.total"), F.col("b.total"), F.col("b.total") - F.col("a.total")
            ),
        ).otherwise("N/A; no observations"),
        "newly_observed_blue": F.concat(
            n.cast("string"), F.lit("; confirmed new followers: "), show(F.col("confirmed_new_followers"), "unknown")
        ),
        "quality_classification": F.format_string(
            "%d high / %d not matched / %d unclassified", F.col("high"), F.col("not_high"), F.col("unknown")
        ),
        "high_quality_share": F.coalesce(
            share,
            F.when(F.col("unknown") > 0, "Pending classification; unknown is not zero").otherwise(
                "N/A; no observed arrivals"
            ),
        ),
        "quality_bounds": F.coalesce(bounds, F.lit("N/A")),
        "cohort_window": F.concat(
            show(utc_text(F.col("window_started_at"), 0), stamp),
            F.lit(" -> "),
            show(utc_text(F.col("window_ended_at"), 0), stamp),
        ),
        "latest_profile_observation": show(utc_text(F.col("b.observed_at"), 0), stamp),
        "first_profile_observation": show(utc_text(F.col("a.observed_at"), 0), stamp),
        "blue_count_observation": show(utc_text(F.col("blue_at"), 0), stamp),
        "list_coverage": coverage_label(
            F.col("complete"), F.col("scope"), F.col("captured_list_count"), F.col("end_profile_total")
        ),
    }
    items = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(k).alias("metric"), v.alias("value"))
            for i, (k, v) in enumerate(values.items())
        ]
    )
    return rows.select("account", F.explode(items).alias("_m")).select("account", "_m.*").filter(
        F.col("value").isNotNull()
    )

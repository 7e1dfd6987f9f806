"""Table computations with a written definition: signals, costs, pause rule, ranking arithmetic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import POPULAR_HALF_LIFE_HOURS, safe_ratio
from .ordered import HOT_ROWS, with_previous


def network_signal(followers: Column, following: Column) -> Column:
    """Smoothed log ratio of followers to following; null when a count is missing."""
    return F.log((followers + 1) / (following + 1))


def co_observed_rate(net_followers: Column, impressions: Column) -> Column:
    """Net followers per thousand impressions of the same window; may be negative."""
    return safe_ratio(net_followers * 1000, impressions)


def task_costs(attempts: DataFrame, group: str, task: str) -> DataFrame:
    """Spend and unit costs per group from one row per attempt.

    Attempts carry phase (autonomous or rescue), cost and passed. A missing cost or outcome makes
    the ratios of its group null; successes are counted by distinct task.
    """
    auto = F.col("phase") == "autonomous"
    per_task = attempts.groupBy(group, task).agg(
        F.sum(F.when(auto, F.col("cost"))).alias("auto_cost"),
        F.sum("cost").alias("all_cost"),
        F.bool_or(F.coalesce(auto & F.col("passed"), F.lit(False))).alias("auto_pass"),
        F.bool_or(F.coalesce(F.col("passed"), F.lit(False))).alias("any_pass"),
        F.count_if(F.col("cost").isNull() | F.col("passed").isNull()).alias("n_unknown"),
    )
    sums = per_task.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if("auto_pass").alias("n_autonomous"),
        F.count_if(~F.col("auto_pass") & F.col("any_pass")).alias("n_rescued"),
        F.count_if(~F.col("any_pass")).alias("n_failed"),
        F.sum("n_unknown").alias("n_unknown"),
        F.sum("auto_cost").alias("autonomous_spend"),
        F.sum("all_cost").alias("total_spend"),
        F.min("all_cost").alias("min_task_cost"),
        F.max("all_cost").alias("max_task_cost"),
    )
    known = F.col("n_unknown") == 0
    return sums.withColumn(
        "spend_per_autonomous_success",
        F.when(known, safe_ratio(F.col("autonomous_spend"), F.col("n_autonomous"))),
    ).withColumn(
        "spend_per_success",
        F.when(known, safe_ratio(F.col("total_spend"), F.col("n_autonomous") + F.col("n_rescued"))),
    )


def pause_rule(rounds: DataFrame, keys: Sequence[str], order: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pause after two consecutive completed rounds that both measured zero feedback and visits.

    A null reading never counts as zero.
    """
    zero = F.coalesce(
        F.col("completed") & (F.col("feedback") == 0) & (F.col("profile_visits") == 0), F.lit(False)
    )
    rows = with_previous(rounds.withColumn("_zero", zero), keys, order, ["_zero"], (), hot_rows)
    return rows.withColumn(
        "pause", F.col("_zero") & F.coalesce(F.col("prev._zero"), F.lit(False))
    ).drop("_zero", "prev")


# Public default weights of the predicted heads.
POSITIVE_WEIGHTS = {
    "favorite": 0.5,
    "reply": 5.0,
    "retweet": 1.0,
    "photo_expand": 0.05,
    "video_open": 0.07,
    "click": 0.3,
    "open_link": 0.2,
    "profile_click": 0.0,
    "vqv": 0.0,
    "share": 2.0,
    "share_via_dm": 5.0,
    "share_via_copy_link": 20.0,
    "dwell": 0.05,
    "quote": 5.0,
    "quoted_click": 0.05,
    "quoted_vqv": 0.0,
    "follow_author": 4.0,
    "post_unexplored": 0.02,
}
CONTINUOUS_WEIGHTS = {"cont_dwell_time": 0.004, "cont_click_dwell_time": 0.4}
NEGATIVE_WEIGHTS = {
    "not_interested": -47.52,
    "block_author": -31.2,
    "mute_author": -58.8,
    "report": -234.0,
    "not_dwelled": -0.02,
}
OFFSET = 0.001
REPLY_BOOST = 15.0
DIVERSITY_DECAY = 0.5
DIVERSITY_FLOOR = 0.25
OUT_OF_NETWORK = 0.75
OUT_OF_NETWORK_TOPIC = 0.5
EXPLORATION_SHARE = 0.03


def weighted_score(heads: Mapping[str, Column], weights: Mapping[str, float | Column]) -> Column:
    """Weighted sum of predicted heads; a missing head counts as zero."""
    total = F.lit(0.0)
    for name, p in heads.items():
        total = total + F.coalesce(p, F.lit(0.0)) * weights[name]
    return total


def offset_score(q: Column, positive_sum: float, negative_sum: float) -> Column:
    """Piecewise offset of a raw score; ``negative_sum`` is the positive size of the negatives."""
    total = positive_sum + negative_sum
    if total == 0:
        return F.greatest(q, F.lit(0.0))
    return F.when(q < 0, (q + negative_sum) * OFFSET / total).otherwise(q + OFFSET)


def reply_weight(mutual: Column, is_reply: Column, is_repost: Column, base: float = 5.0) -> Column:
    return F.when(mutual & ~is_reply & ~is_repost, F.lit(base + REPLY_BOOST)).otherwise(F.lit(base))


def network_factor(in_network: Column, topic_request: Column) -> Column:
    """Factor of out-of-network candidates; an unknown network state does not trigger it."""
    return F.when(
        in_network == F.lit(False),
        F.when(topic_request, F.lit(OUT_OF_NETWORK_TOPIC)).otherwise(F.lit(OUT_OF_NETWORK)),
    ).otherwise(F.lit(1.0))


def diversity_factor(
    candidates: DataFrame, pool: str, author: str, score: str, candidate: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(1 - f) d^k + f, where k counts better-scored candidates of the same author in the pool."""
    ranked = candidates.withColumn("_order", F.floor(-F.col(score) * 1_000_000).cast("bigint")).withColumn(
        "_minus", -F.col(score)
    )
    ranked = with_previous(ranked, [pool, author], "_order", [], ["_minus", candidate], hot_rows, "_p", True)
    k = F.col("position") - 1
    return ranked.withColumn("earlier_same_author", k).withColumn(
        "diversity_factor",
        F.pow(F.lit(DIVERSITY_DECAY), k) * (1 - DIVERSITY_FLOOR) + DIVERSITY_FLOOR,
    ).drop("_order", "_minus", "_p", "position", "is_last")


def exploration_threshold(followers: Column, age_hours: Column) -> Column:
    """Views a post of this age should have reached; half-life eight hours, window one day."""
    age = F.least(F.greatest(age_hours, F.lit(0.0)), F.lit(24.0))
    return (
        followers
        * EXPLORATION_SHARE
        * (F.lit(1.0) - F.pow(F.lit(2.0), -age / POPULAR_HALF_LIFE_HOURS))
        / (1 - 2.0**-3)
    )


def is_unexplored(views: Column, followers: Column, age_hours: Column, is_reply: Column) -> Column:
    inside = (age_hours >= 0) & (age_hours <= 24)
    return F.when(inside & ~is_reply, views < exploration_threshold(followers, age_hours))

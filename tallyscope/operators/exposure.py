"""Exposure series, rolling-origin baselines, extrapolation and error summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.links import is_exact_post
from ..functions.numeric import (
    horizon_bucket,
    horizon_order,
    popular_score,
    popular_status,
    recent_rate_prediction,
    signed_error,
    symmetric_percent,
)
from ..functions.times import seconds_between
from .ordered import HOT_ROWS, find_hot, with_previous

SERIES = ["url", "source"]
# Collection to surface and counter column.
SURFACES = {
    "posts": ("public_views", "views"),
    "post_observations": ("public_views", "views"),
    "analytics_observations": ("owner_impressions", "impressions"),
}


def stack_collections(collections: dict[str, DataFrame]) -> DataFrame:
    """One long table of captures from the three collections, tagged with their surface."""
    parts = []
    for name, df in collections.items():
        source, counter = SURFACES[name]
        parts.append(
            df.select(
                F.lit(name).alias("collection"),
                F.col("index"),
                "url",
                F.lit(source).alias("source"),
                "published_at",
                "observed_at",
                F.col(counter).alias("value"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def load_series(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, skipped rows with a reason, rejected keys with a rule).

    A capture needs a clock, a counter and a publication time known for its exact url. Repeats of
    one instant collapse when equal and are rejected when they differ.
    """
    exact = is_exact_post(F.col("url"))
    bad_url = rows.filter(~F.coalesce(exact, F.lit(False))).select(
        "url", "source", F.lit("url_not_exact").alias("rule")
    )
    rows = rows.filter(exact)
    clocks = (
        rows.filter(F.col("published_at").isNotNull())
        .groupBy("url")
        .agg(F.min("published_at").alias("publication"), F.max("published_at").alias("_other"))
    )
    known = clocks.filter(F.col("publication") == F.col("_other")).drop("_other")
    clock_conflict = clocks.filter(F.col("publication") != F.col("_other")).select(
        "url", F.lit(None).cast("string").alias("source"), F.lit("conflicting_published_at").alias("rule")
    )
    joined = rows.drop("published_at").join(known, "url", "left")
    tagged = joined.withColumn(
        "skip_reason",
        F.when(F.col("observed_at").isNull(), "missing_observed_at")
        .when(F.col("value").isNull(), "missing_counter")
        .when(F.col("publication").isNull(), "missing_published_at"),
    )
    skipped = tagged.filter(F.col("skip_reason").isNotNull())
    grouped = (
        tagged.filter(F.col("skip_reason").isNull())
        .groupBy(*SERIES, "observed_at")
        .agg(
            F.first("publication").alias("published_at"),
            F.min("value").alias("value"),
            F.max("value").alias("_high"),
        )
    )
    early = F.col("observed_at") < F.col("published_at")
    conflict = F.col("value") != F.col("_high")
    rejected = (
        grouped.filter(early | conflict)
        .select(
            *SERIES,
            F.when(early, "observed_before_publication").otherwise("conflicting_counters").alias("rule"),
        )
        .unionByName(clock_conflict)
        .unionByName(bad_url)
    )
    points = grouped.filter(~early & ~conflict).select(
        *SERIES,
        "published_at",
        "observed_at",
        seconds_between(F.col("published_at"), F.col("observed_at")).alias("age_seconds"),
        "value",
    )
    return points, skipped, rejected


def hot_series(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame | bool:
    """Series above the limit, found on the stacked rows before any join or grouping."""
    return find_hot(rows.filter(F.col("observed_at").isNotNull()), SERIES, "observed_at", hot_rows)


def series_status(
    points: DataFrame, hot_rows: int = HOT_ROWS, hot: DataFrame | bool | None = None
) -> DataFrame:
    """Status, size and number of revisions per series; any fall makes the series a revision."""
    rows = with_previous(points, SERIES, "observed_at", ["value"], (), hot_rows, hot=hot)
    return rows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.count_if(F.col("value") < F.col("prev.value")).alias("n_revisions"),
    ).withColumn(
        "status",
        F.when(F.col("n_revisions") > 0, "counter_revision")
        .when(F.col("n_points") < 3, "insufficient_data")
        .otherwise("usable"),
    )


def unrevised(
    points: DataFrame, hot_rows: int = HOT_ROWS, hot: DataFrame | bool | None = None
) -> DataFrame:
    """Points of series without any revision, each with its two predecessors and flags."""
    if hot is None:
        hot = find_hot(points, SERIES, "observed_at", hot_rows)
    rows = with_previous(
        points, SERIES, "observed_at", ["age_seconds", "value"], name="last", flags=True, hot=hot
    )
    rows = with_previous(rows, SERIES, "observed_at", ["last"], name="_back", hot=hot)
    rows = rows.withColumn("before", F.col("_back.last")).drop("_back")
    fell = F.col("value") < F.col("last.value")
    if hot is False:
        # The series is already one window partition here, so the flag costs no further shuffle.
        whole = Window.partitionBy(*SERIES)
        flagged = rows.withColumn("_revised", F.max(F.coalesce(fell, F.lit(False))).over(whole))
        return flagged.filter(~F.col("_revised")).drop("_revised")
    revised = rows.filter(fell).select(*SERIES).distinct()
    return rows.join(revised, SERIES, "left_anti")


def rolling_predictions(rows: DataFrame) -> DataFrame:
    """Predict every point from the third on with the two points before it; long over models."""
    origin_age, origin_value = F.col("last.age_seconds"), F.col("last.value")
    span = origin_age - F.col("before.age_seconds")
    horizon = F.col("age_seconds") - origin_age
    wide = rows.filter(F.col("before").isNotNull()).select(
        *SERIES,
        F.col("last.observed_at").alias("origin_at"),
        F.col("observed_at").alias("target_at"),
        (F.col("position") - 1).alias("training_points"),
        F.col("value").alias("actual"),
        horizon.alias("forecast_horizon_seconds"),
        horizon_bucket(horizon).alias("horizon_bucket"),
        F.col("is_last").alias("latest_holdout"),
        origin_value.cast("double").alias("constant"),
        recent_rate_prediction(F.col("before.value"), origin_value, span, horizon).alias("recent_rate"),
    )
    keep = [c for c in wide.columns if c not in ("constant", "recent_rate")]
    long = wide.unpivot(keep, ["constant", "recent_rate"], "model", "prediction")
    return add_errors(long)


def add_errors(df: DataFrame, actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    a, p = F.col(actual), F.col(prediction)
    signed = signed_error(a, p)
    return (
        df.withColumn("signed_error", signed)
        .withColumn("absolute_error", F.abs(signed))
        .withColumn("squared_error", signed * signed)
        .withColumn("smape_percent", symmetric_percent(a, p))
    )


def error_summary(
    predictions: DataFrame, keys: Sequence[str] = ("source", "model", "horizon_bucket"), post: str = "url"
) -> DataFrame:
    """Errors over all predictions and over the latest holdouts only, in one pass.

    Posts are counted by first collapsing to one row per post, which is combined on the map side.
    """
    hold = F.col("latest_holdout")

    def only(c: str) -> Column:
        return F.when(hold, F.col(c))

    per_post = predictions.groupBy(*keys, post).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("absolute_error").alias("ae"),
        F.sum("squared_error").alias("se"),
        F.sum("signed_error").alias("be"),
        F.sum("smape_percent").alias("pe"),
        F.count_if(hold).alias("hn"),
        F.sum(only("absolute_error")).alias("hae"),
        F.sum(only("squared_error")).alias("hse"),
    )
    n, hn = F.sum("n"), F.sum("hn")
    some = F.when(hn > 0, hn)
    return per_post.groupBy(*keys).agg(
        n.alias("n_predictions"),
        F.count(F.lit(1)).alias("n_posts"),
        (F.sum("ae") / n).alias("mae"),
        F.sqrt(F.sum("se") / n).alias("rmse"),
        (F.sum("be") / n).alias("bias_predicted_minus_actual"),
        (F.sum("pe") / n).alias("smape_percent"),
        hn.alias("latest_n_predictions"),
        (F.sum("hae") / some).alias("latest_mae"),
        F.sqrt(F.sum("hse") / some).alias("latest_rmse"),
    )


def matched_origins(predictions: DataFrame, trained: str) -> DataFrame:
    """Restrict every model to the origins the trained model could score."""
    keys = [*SERIES, "target_at"]
    scored = predictions.filter(F.col("model") == trained).select(*keys).distinct()
    return predictions.join(scored, keys, "left_semi")


def model_table(summaries: DataFrame, models: Sequence[str], metric: str = "mae") -> DataFrame:
    """One row per surface and horizon with the mean error of each model side by side."""
    return (
        summaries.groupBy("source", "horizon_bucket")
        .pivot("model", list(models))
        .agg(F.first(metric))
        .withColumn("horizon_rank", horizon_order(F.col("horizon_bucket")))
    )


def extrapolate(rows: DataFrame, forecast_hours: float = 24.0) -> DataFrame:
    """Forecast every series at a fixed post age from its last two points."""
    target = F.lit(forecast_hours * 3600.0)
    ends = rows.filter(F.col("is_last") & F.col("last").isNotNull() & (target > F.col("age_seconds")))
    horizon = target - F.col("age_seconds")
    span = F.col("age_seconds") - F.col("last.age_seconds")
    return ends.select(
        *SERIES,
        F.col("observed_at").alias("origin_at"),
        F.timestamp_micros(
            F.unix_micros("published_at") + F.lit(int(forecast_hours * 3_600_000_000))
        ).alias("target_at"),
        horizon.alias("forecast_horizon_seconds"),
        F.col("value").cast("double").alias("constant"),
        recent_rate_prediction(F.col("last.value"), F.col("value"), span, horizon).alias("recent_rate"),
    )


def popular_scores(points: DataFrame) -> DataFrame:
    """Popular-pool score of the latest public capture of every post."""
    latest = (
        points.filter(F.col("source") == "public_views")
        .groupBy("url")
        .agg(F.max(F.struct("observed_at", "age_seconds", "value")).alias("_l"))
        .select("url", "_l.*")
    )
    return latest.withColumn("score", popular_score(F.col("value"), F.col("age_seconds"))).withColumn(
        "status", popular_status(F.col("age_seconds"))
    )


def popular_pool(scores: DataFrame, author: str, per_author: int = 5, total: int = 500) -> DataFrame:
    """Best ``per_author`` posts of every author, then the best ``total`` of the pool.

    The per-author cut is taken in two steps so that a very busy author is first reduced in
    slices; the global cut is a distributed top-k.
    """
    best = [F.col("score").desc(), F.col("url")]
    live = scores.filter(F.col("score").isNotNull()).withColumn(
        "_slice", F.pmod(F.xxhash64("url"), F.lit(64))
    )
    by_slice = Window.partitionBy(author, "_slice").orderBy(*best)
    sliced = live.withColumn("_r", F.row_number().over(by_slice)).filter(F.col("_r") <= per_author)
    by_author = Window.partitionBy(author).orderBy(*best)
    return (
        sliced.withColumn("author_rank", F.row_number().over(by_author).cast("bigint"))
        .filter(F.col("author_rank") <= per_author)
        .drop("_r", "_slice")
        .orderBy(*best)
        .limit(total)
    )

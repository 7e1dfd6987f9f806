"""Count, interval and binary classification metrics by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import count_bucket, early_rate_prediction, pinball, safe_ratio, stable_nll
from .ordered import exact_quantiles, running_position

TEMPERATURES = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 8.0)
SMALL_GROUP = 30


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two aggregate results; without keys both are single rows."""
    return left.join(right, list(keys)) if keys else left.join(F.broadcast(right), F.lit(True))


def strata(df: DataFrame, observed: str, actual: str, with_zero: bool = True) -> DataFrame:
    """Repeat each row for every stratum it belongs to (two or three rows per input row)."""
    names = [
        F.lit("all"),
        F.when(F.col(observed) == 0, "cold_at_cutoff").otherwise("warm_at_cutoff"),
    ]
    if with_zero:
        names.append(F.when(F.col(actual) == 0, "zero_target"))
    tagged = df.withColumn("stratum", F.explode(F.array(*names)))
    return tagged.filter(F.col("stratum").isNotNull())


def count_metrics(
    df: DataFrame, keys: Sequence[str], actual: str = "actual", prediction: str = "prediction"
) -> DataFrame:
    """Error metrics of count predictions per group; WAPE is null when nothing happened."""
    a, p = F.col(actual).cast("double"), F.col(prediction).cast("double")
    rows = df.select(*keys, a.alias("_a"), p.alias("_p"), F.abs(a - p).alias("_e"))
    e = F.col("_e")
    wanted = {"median_absolute_error": 0.5, "p90_absolute_error": 0.9}
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cascades"),
        F.avg(e).alias("mae"),
        F.avg(F.abs(F.log1p("_a") - F.log1p("_p"))).alias("log1p_mae"),
        safe_ratio(F.sum(e), F.sum("_a")).alias("wape"),
        F.sum("_a").alias("sum_actual"),
        F.avg(F.col("_p") - F.col("_a")).alias("bias_predicted_minus_actual"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    )
    return join_groups(totals, exact_quantiles(rows, keys, "_e", wanted), keys)


def interval_metrics(
    df: DataFrame, keys: Sequence[str], actual: str = "actual", low: str = "lower", high: str = "upper"
) -> DataFrame:
    """Empirical coverage and mean width of the interval."""
    inside = F.col(actual).between(F.col(low), F.col(high))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(inside.cast("double")).alias("interval_80_empirical_coverage"),
        F.avg(F.col(high) - F.col(low)).alias("interval_80_mean_width"),
    )


def pinball_loss(
    df: DataFrame, keys: Sequence[str], actual: Column, predictions: dict[float, Column]
) -> DataFrame:
    """Mean pinball loss over rows and quantiles."""
    total = F.lit(0.0)
    for q, p in predictions.items():
        total = total + pinball(actual, p, q)
    return df.groupBy(*keys).agg(F.avg(total / len(predictions)).alias("pinball_loss"))


# --- baselines --------------------------------------------------------------------------------


def fit_baselines(
    train: DataFrame, keys: Sequence[str] = ("cutoff_seconds",)
) -> tuple[DataFrame, DataFrame]:
    """(median per key, median per key and count bucket) of the training targets.

    Targets are counts, so the exact percentile keeps one entry per distinct count; there are at
    most 63 buckets per key.
    """
    rows = train.withColumn("bucket", count_bucket(F.col("observed_retweet_count")))
    target = "future_retweets_to_24h"
    overall = rows.groupBy(*keys).agg(
        F.median(target).alias("constant_median"), F.count(F.lit(1)).alias("training_cascades")
    )
    buckets = rows.groupBy(*keys, "bucket").agg(
        F.median(target).alias("bucket_median"), F.count(F.lit(1)).alias("bucket_training_count")
    )
    return overall, buckets


def baseline_predictions(
    rows: DataFrame, overall: DataFrame, buckets: DataFrame, keys: Sequence[str] = ("cutoff_seconds",)
) -> DataFrame:
    """Four baselines per row; an unseen bucket falls back to the training median.

    The two fitted tables have one row per cutoff and at most 63 buckets each, so they are
    broadcast whatever the data size.
    """
    observed = F.col("observed_retweet_count")
    keys = list(keys)
    return (
        rows.withColumn("bucket", count_bucket(observed))
        .join(F.broadcast(overall.select(*keys, "constant_median")), keys)
        .join(F.broadcast(buckets.select(*keys, "bucket", "bucket_median")), [*keys, "bucket"], "left")
        .withColumn("zero_additional_keep_last_count", F.lit(0.0))
        .withColumn("constant_train_median", F.col("constant_median").cast("double"))
        .withColumn("early_constant_rate", early_rate_prediction(observed, F.col("cutoff_seconds")))
        .withColumn(
            "train_log_count_bucket_median",
            F.coalesce(F.col("bucket_median"), F.col("constant_median")).cast("double"),
        )
        .drop("constant_median", "bucket_median")
    )


BASELINES = (
    "zero_additional_keep_last_count",
    "constant_train_median",
    "early_constant_rate",
    "train_log_count_bucket_median",
)


def prediction_rows(wide: DataFrame, models: Sequence[str] = BASELINES) -> DataFrame:
    """Long export of predictions: id, cutoff, cold flag, actual, model, prediction."""
    return wide.select(
        "cascade_id",
        "cutoff_seconds",
        F.col("observed_retweet_count"),
        (F.col("observed_retweet_count") == 0).cast("int").alias("cold_at_cutoff"),
        F.col("future_retweets_to_24h").alias("actual"),
        *models,
    ).unpivot(
        ["cascade_id", "cutoff_seconds", "observed_retweet_count", "cold_at_cutoff", "actual"],
        list(models),
        "model",
        "prediction",
    )


def normaliser(df: DataFrame, features: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per feature, a zero deviation becoming one."""
    out = []
    for name, c in features.items():
        deviation = F.stddev_pop(c)
        out += [
            F.avg(c).alias(f"{name}_mean"),
            F.when(deviation == 0, F.lit(1.0)).otherwise(deviation).alias(f"{name}_scale"),
        ]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fit"), *out)


def matched_comparison(metrics: DataFrame, baseline: str, model: str, keys: Sequence[str]) -> DataFrame:
    """Relative error reduction of a model over its matched baseline and the metrics that got worse."""
    names = ["mae", "log1p_mae", "median_absolute_error", "p90_absolute_error", "wape", "rmse"]
    base = metrics.filter(F.col("model") == baseline).select(
        *keys, "n_cascades", *[F.col(c).alias(f"base_{c}") for c in names]
    )
    other = metrics.filter(F.col("model") == model).select(
        *keys, F.col("n_cascades").alias("_n"), *[F.col(c).alias(f"model_{c}") for c in names]
    )
    worse = F.filter(
        F.array(*[F.when(F.col(f"model_{c}") > F.col(f"base_{c}"), F.lit(c)) for c in names]),
        lambda c: c.isNotNull(),
    )
    return base.join(other, list(keys)).filter(F.col("n_cascades") == F.col("_n")).select(
        *keys,
        "n_cascades",
        F.col("base_mae").alias("baseline_mae"),
        F.col("model_mae").alias("model_mae"),
        safe_ratio(F.col("base_mae") - F.col("model_mae"), F.col("base_mae")).alias("mae_reduction_ratio"),
        F.array_join(worse, ",").alias("regressions"),
    )


# --- binary classification --------------------------------------------------------------------


# Quantile edges of the scores, and even steps between two edges.
EDGES, FINE = 64, 64


def tie_ranks(df: DataFrame, keys: Sequence[str], score: str = "probability", label: str = "label") -> DataFrame:
    """Average rank of every distinct score per group, with its positives and negatives.

    Rows are first reduced to distinct scores. Bins lie between approximate quantiles of the distinct
    scores and are cut again at even steps, so scores that crowd anywhere, as those of a confident
    classifier do near one, still fill many bins of like size and no group is ranked in a single task.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("n_positive")
    )
    cuts = F.array(*[F.lit(i / EDGES) for i in range(EDGES + 1)])
    edges = counts.groupBy(*keys).agg(F.percentile_approx(F.col("score").cast("double"), cuts, 20 * EDGES).alias("_edges"))
    # Without keys this is one aggregated row.
    ranked = counts.join(edges, keys) if keys else counts.join(F.broadcast(edges), F.lit(True))
    ranked = ranked.withColumn("_at", F.size(F.filter("_edges", lambda e: e <= F.col("score"))))
    low, high = F.get("_edges", F.col("_at") - 1), F.get("_edges", F.col("_at"))
    step = F.when(high > low, F.floor(FINE * (F.col("score") - low) / (high - low)))
    binned = ranked.withColumn("_bin", F.col("_at") * FINE + F.greatest(F.lit(0), F.least(F.lit(FINE - 1), F.coalesce(step, F.lit(0)))))
    placed = running_position(binned, keys, "_bin", ["score"], {"_before": "n"})
    return placed.select(
        *keys,
        "score",
        "n",
        "n_positive",
        (F.col("_before") + (F.col("n") + 1) / 2).alias("average_rank"),
    )


def auroc(df: DataFrame, keys: Sequence[str], score: str = "probability", label: str = "label") -> DataFrame:
    """Area under the curve from tie-averaged ranks; null for a group with one class."""
    ranks = tie_ranks(df, keys, score, label)
    sums = ranks.groupBy(*keys).agg(
        F.sum(F.col("average_rank") * F.col("n_positive")).alias("_r"),
        F.sum("n_positive").alias("_p"),
        F.sum("n").alias("_n"),
    )
    p, n = F.col("_p"), F.col("_n") - F.col("_p")
    return sums.select(
        *keys,
        safe_ratio(F.col("_r") - p * (p + 1) / 2, (p * n)).alias("auroc"),
    )


def binary_metrics(
    df: DataFrame, keys: Sequence[str], probability: str = "probability", label: str = "label"
) -> DataFrame:
    """Confusion counts, accuracy, F1, Brier and clipped log loss per group."""
    p, y = F.col(probability), F.col(label)
    guess = (p >= 0.5).cast("int")
    chosen = F.when(y == 1, p).otherwise(F.lit(1.0) - p)
    base = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y == 0).alias("human_written"),
        F.count_if(y == 1).alias("ai_generated"),
        F.count_if((y == 1) & (guess == 1)).alias("tp"),
        F.count_if((y == 0) & (guess == 0)).alias("tn"),
        F.count_if((y == 0) & (guess == 1)).alias("fp"),
        F.count_if((y == 1) & (guess == 0)).alias("fn"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-F.log(F.greatest(F.lit(1e-15), chosen))).alias("negative_log_likelihood"),
    )
    tp, tn, wrong = F.col("tp"), F.col("tn"), F.col("fp") + F.col("fn")
    f1_ai = safe_ratio(tp * 2, tp * 2 + wrong)
    f1_human = safe_ratio(tn * 2, tn * 2 + wrong)
    return (
        base.withColumn("accuracy", safe_ratio(tp + tn, F.col("n")))
        .withColumn("f1_ai", f1_ai)
        .withColumn("f1_macro", (f1_ai + f1_human) / 2)
        .withColumn("small_group", F.col("n") < SMALL_GROUP)
    )


def reliability(
    df: DataFrame, keys: Sequence[str], probability: str = "probability", label: str = "label"
) -> DataFrame:
    """Ten equal-width confidence bins per group; empty bins are kept with null means."""
    p = F.col(probability)
    guess = (p >= 0.5).cast("int")
    confidence = F.when(guess == 1, p).otherwise(F.lit(1.0) - p)
    filled = (
        df.select(
            *keys,
            F.least(F.lit(9), F.floor(confidence * 10)).cast("int").alias("bin"),
            (guess == F.col(label)).cast("double").alias("_hit"),
            confidence.alias("_c"),
        )
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("_hit").alias("accuracy"),
            F.avg("_c").alias("mean_confidence"),
        )
    )
    frame = filled.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return frame.join(filled, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("bin") / 10).alias("lower"),
        ((F.col("bin") + 1) / 10).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
        "accuracy",
        "mean_confidence",
    )


def calibration_error(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return bins.groupBy(*keys).agg(safe_ratio(F.sum(gap), F.sum("n")).alias("ece"))


def temperature_grid(
    df: DataFrame, keys: Sequence[str], logit: str = "logit", label: str = "label", temperatures: Sequence[float] = TEMPERATURES
) -> DataFrame:
    """Mean negative log likelihood at every temperature, all in one aggregate."""
    y = F.col(label).cast("double")
    wide = df.groupBy(*keys).agg(
        *[F.avg(stable_nll(F.col(logit), y, t)).alias(f"t{i}") for i, t in enumerate(temperatures)]
    )
    grid = F.array(
        *[
            F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll"))
            for i, t in enumerate(temperatures)
        ]
    )
    return wide.select(*keys, F.explode(grid).alias("_g")).select(*keys, "_g.*")


def choose_temperature(grid: DataFrame, keys: Sequence[str], epoch: Column | None = None) -> DataFrame:
    """Smallest loss, then earliest epoch, then the temperature nearest one, then the smallest."""
    t = F.col("temperature")
    order = F.struct(
        F.col("nll"),
        (epoch if epoch is not None else F.lit(0)).alias("epoch"),
        F.abs(F.log(t)).alias("distance"),
        t,
    )
    return grid.groupBy(*keys).agg(F.min(order).alias("_b")).select(
        *keys, F.col("_b.temperature").alias("temperature"), F.col("_b.nll").alias("nll"), F.col("_b.epoch").alias("epoch")
    )


def choose_candidate(
    metrics: DataFrame, keys: Sequence[str], metric: str, declared: Sequence[str], epoch: str | None = None
) -> DataFrame:
    """Best candidate by metric, then epoch, then declared order."""
    rank = F
    for i, name in enumerate(declared):
        rank = rank.when(F.col("model") == name, i)
    order = F.struct(
        F.col(metric).alias("value"),
        (F.col(epoch) if epoch else F.lit(0)).alias("epoch"),
        rank.alias("declared"),
        F.col("model"),
    )
    return (
        metrics.filter(F.col("model").isin(*declared))
        .groupBy(*keys)
        .agg(F.min(order).alias("_b"))
        .select(*keys, F.col("_b.model").alias("selected_model"), F.col("_b.value").alias(metric))
    )


def coverage_share(df: DataFrame, flag: Column, keys: Sequence[str] = (), name: str = "coverage") -> DataFrame:
    """Share of rows with a flag, such as decided or labelled rows."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(flag).alias("n_flagged"),
        F.avg(F.coalesce(flag, F.lit(False)).cast("double")).alias(name),
    )

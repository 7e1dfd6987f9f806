"""Queries over event cascades, baselines, count metrics and network fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import cascades as ops
from ..operators import metrics, splits, validation
from ..plans import fitting, reports
from ..schemas import FEATURE_LABELS
from .registry import R, query, r6
from .views import CASCADES, cascade_events, cascade_index


def assigned(spark, folder):
    return ops.assign_events(cascade_index(spark, folder), cascade_events(spark, folder))


def feature_table(spark, folder):
    index = cascade_index(spark, folder)
    usable = ops.usable_segments(ops.id_flags(index))
    return ops.features(usable, ops.cascade_counts(assigned(spark, folder)))


@query(
    "range_join",
    f"WITH {CASCADES} SELECT sequence, ordinal, raw AS relative_time_second, is_origin FROM asg",
)
def range_join(spark, folder):
    return assigned(spark, folder).select("sequence", "ordinal", "relative_time_second", "is_origin")


@query(
    "broken_ranges",
    f"""WITH {CASCADES}, x AS (SELECT sequence, start_ind + CASE WHEN sequence % 9 = 4 THEN 1 ELSE 0 END AS start_ind, end_ind FROM idx),
    y AS (SELECT *, coalesce(lag(end_ind) OVER (ORDER BY sequence) + 1, 1) AS expected_start FROM x)
    SELECT sequence, start_ind, end_ind, expected_start FROM y WHERE start_ind <> expected_start""",
)
def broken_ranges(spark, folder):
    index = cascade_index(spark, folder)
    shifted = F.col("start_ind") + F.when(F.col("sequence") % 9 == 4, 1).otherwise(0)
    return ops.broken_ranges(index.withColumn("start_ind", shifted))


@query(
    "origin_check",
    f"WITH {CASCADES}, x AS (SELECT sequence, min(ordinal) AS ordinal FROM asg WHERE ordinal % 50 > 2 GROUP BY 1) SELECT x.sequence, x.ordinal FROM x JOIN asg a ON a.ordinal = x.ordinal WHERE a.t <> 0",
)
def origin_check(spark, folder):
    index = cascade_index(spark, folder)
    # Starting each segment three events late must be reported unless that event is at zero.
    late = index.withColumn("start_ind", F.col("start_ind") + 2)
    return ops.bad_origins(ops.assign_events(late, cascade_events(spark, folder)))


@query(
    "id_quarantine",
    f"""WITH {CASCADES} SELECT sequence AS segment_index, substr(sha256(tweet_id), 1, 12) AS raw_id_hash_prefix, {R('day')} AS post_time_day, start_ind, end_ind,
    noncanonical AS noncanonical_id, repeated AS repeated_raw_id FROM fl WHERE noncanonical OR repeated""",
)
def id_quarantine(spark, folder):
    rows = ops.quarantined_ids(ops.id_flags(cascade_index(spark, folder)))
    return rows.withColumn("post_time_day", r6("post_time_day"))


FEATURE_SQL = f"""SELECT cascade_id, {R('day')} AS post_time_day, cutoff AS cutoff_seconds, paper AS paper_day_split, strict AS strict_label_available_split, observed AS observed_retweet_count,
    first_at AS first_observed_retweet_seconds, last_at AS last_observed_retweet_seconds, future AS future_retweets_to_24h, total AS total_retweets_at_24h, {R('day + 1')} AS label_available_day"""


@query("cascade_features", f"WITH {CASCADES} {FEATURE_SQL} FROM feat")
def cascade_features(spark, folder):
    rows = feature_table(spark, folder)
    return rows.withColumn("post_time_day", r6("post_time_day")).withColumn("label_available_day", r6("label_available_day"))


@query(
    "cascade_coverage",
    f"""WITH {CASCADES}, i AS (SELECT tweet_id, count(*) AS n, regexp_full_match(tweet_id, '[1-9][0-9]*') AS ok FROM idx GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS index_rows, count(*) AS unique_raw_id_strings, count(*) FILTER (ok) AS canonical_unique_id_strings, CAST(coalesce(sum(n) FILTER (ok), 0) AS BIGINT) AS canonical_segments,
    CAST(coalesce(sum(n) FILTER (NOT ok), 0) AS BIGINT) AS noncanonical_segments, count(*) FILTER (n > 1) AS repeated_id_count, CAST(coalesce(sum(n) FILTER (NOT ok OR n > 1), 0) AS BIGINT) AS quarantined_segments,
    count(*) FILTER (ok AND n = 1) AS usable_unique_cascades, (SELECT max(end_ind) FROM idx) AS indexed_event_rows,
    (SELECT min(day) FROM idx) AS min_post_time_day, (SELECT max(day) FROM idx) AS max_post_time_day FROM i""",
)
def cascade_coverage(spark, folder):
    return ops.coverage(cascade_index(spark, folder))


@query("cascades_by_day", f"WITH {CASCADES} SELECT CAST(floor(day) AS BIGINT) AS day, count(*) AS n_cascades FROM idx GROUP BY 1")
def cascades_by_day(spark, folder):
    return ops.cascades_by_day(cascade_index(spark, folder))


@query(
    "cascade_groups",
    f"""WITH {CASCADES} SELECT cutoff AS cutoff_seconds, strict AS strict_label_available_split, count(*) AS n_rows, count(*) FILTER (observed = 0) AS cold_at_cutoff,
    CAST(sum(observed) AS BIGINT) AS observed_total, CAST(sum(future) AS BIGINT) AS future_total, count(*) FILTER (future > 0) AS future_positive FROM feat GROUP BY 1, 2""",
)
def cascade_groups(spark, folder):
    return ops.group_totals(feature_table(spark, folder))


@query(
    "source_anomalies",
    f"""WITH {CASCADES}, o AS (SELECT *, lag(t) OVER (PARTITION BY sequence ORDER BY ordinal) AS pt FROM asg WHERE NOT is_origin), s AS (SELECT i.sequence, count(a.ordinal) AS n FROM idx i
      LEFT JOIN asg a ON a.sequence = i.sequence AND NOT a.is_origin GROUP BY 1)
    SELECT count(*) FILTER (raw LIKE '%e%') AS scientific_notation_event_times, count(*) FILTER (t <> floor(t)) AS fractional_second_events, count(*) FILTER (t > 1209600) AS events_beyond_14d,
    (SELECT count(*) FROM s WHERE n < 50) AS segments_below_documented_50_retweets, (SELECT min(n) FROM s) AS minimum_retweet_events_per_segment, max(t) AS maximum_event_second,
    count(*) FILTER (t < pt) AS unsorted_event_transitions FROM o""",
)
def source_anomalies(spark, folder):
    return ops.source_anomalies(assigned(spark, folder))


@query(
    "partition_audit",
    f"""WITH {CASCADES} SELECT cutoff AS cutoff_seconds, strict AS outer_split, CASE WHEN strict <> 'train_candidate' THEN 'outside_train' WHEN day + 1 <= 4 THEN 'fit' WHEN day >= 4 AND day < 6 THEN 'validation' ELSE 'purged' END AS inner_split,
    count(*) AS n_cascades, count(*) FILTER (observed = 0) AS n_cold FROM feat GROUP BY 1, 2, 3""",
)
def partition_audit(spark, folder):
    return ops.partition_audit(feature_table(spark, folder))


def damaged_features(spark, folder):
    """Feature rows with planted faults: a wrong total, a shifted first time, or a lost row."""
    rows = feature_table(spark, folder)
    n = F.substring_index("cascade_id", "-", -1).cast("bigint")
    late = F.col("cutoff_seconds") == 3600
    return (
        rows.withColumn(
            "total_retweets_at_24h", F.col("total_retweets_at_24h") + F.when((n % 10 == 3) & late, 1).otherwise(0)
        )
        .withColumn(
            "first_observed_retweet_seconds",
            F.when((n % 10 == 5) & late, F.lit(1.0) + F.col("first_observed_retweet_seconds")).otherwise(
                F.col("first_observed_retweet_seconds")
            ),
        )
        .filter(~((n % 10 == 7) & late))
    )


DAMAGED = """dm AS (SELECT cascade_id, day, strict, cutoff, observed, last_at, future, total + CASE WHEN sequence % 10 = 3 AND cutoff = 3600 THEN 1 ELSE 0 END AS total,
    first_at + CASE WHEN sequence % 10 = 5 AND cutoff = 3600 THEN 1 ELSE 0 END AS first_at FROM feat WHERE NOT (sequence % 10 = 7 AND cutoff = 3600))"""


@query(
    "feature_row_faults",
    f"""WITH {CASCADES}, {DAMAGED}, v AS (SELECT *, CASE WHEN observed = 0 AND (first_at IS NOT NULL OR last_at IS NOT NULL) THEN 'cold_with_times'
      WHEN observed > 0 AND NOT (first_at >= 0 AND first_at <= last_at AND last_at <= cutoff) THEN 'times_outside_cutoff' WHEN observed = 1 AND first_at <> last_at THEN 'single_event_two_times'
      WHEN total <> observed + future THEN 'total_mismatch' END AS rule FROM dm) SELECT cascade_id, cutoff AS cutoff_seconds, rule FROM v WHERE rule IS NOT NULL""",
)
def feature_row_faults(spark, folder):
    _, bad = validation.split(damaged_features(spark, folder), validation.feature_row_rules())
    return bad.select("cascade_id", "cutoff_seconds", "rule")


@query(
    "paired_cutoffs",
    f"""WITH {CASCADES}, {DAMAGED}, p AS (SELECT cascade_id, a.observed AS o1, b.observed AS o2, a.first_at AS f1, b.first_at AS f2, a.last_at AS l1, b.last_at AS l2, a.total AS t1, b.total AS t2, b.cascade_id IS NULL AS lost
      FROM (SELECT * FROM dm WHERE cutoff = 900) a LEFT JOIN (SELECT * FROM dm WHERE cutoff = 3600) b USING (cascade_id))
    SELECT cascade_id, o1 AS observed_900, o2 AS observed_3600, CASE WHEN lost THEN 'cutoff_missing' WHEN t1 <> t2 THEN 'metadata_mismatch' WHEN o1 > o2 THEN 'observed_decreased'
      WHEN o1 = 0 AND o2 > 0 AND f2 <= 900 THEN 'cold_then_early_event' WHEN o2 > o1 AND l2 <= 900 THEN 'new_event_before_cutoff' WHEN o1 > 0 AND (f1 <> f2 OR l1 > l2) THEN 'history_inconsistent'
      WHEN o1 = o2 AND NOT (f1 IS NOT DISTINCT FROM f2 AND l1 IS NOT DISTINCT FROM l2) THEN 'unchanged_count_new_times' END AS rule FROM p""",
)
def paired_cutoffs(spark, folder):
    rows = validation.paired_cutoffs(damaged_features(spark, folder))
    return rows.select("cascade_id", F.col("early.observed").alias("observed_900"), F.col("late.observed").alias("observed_3600"), "rule")


@query(
    "feature_membership",
    f"""WITH {CASCADES} SELECT 'cascade-' || lpad(CAST(sequence AS VARCHAR), 6, '0') AS cascade_id, 'right' AS only_in FROM idx WHERE 'cascade-' || lpad(CAST(sequence AS VARCHAR), 6, '0') NOT IN (SELECT cascade_id FROM feat)""",
)
def feature_membership(spark, folder):
    every = cascade_index(spark, folder).select(F.format_string("cascade-%06d", F.col("sequence")).alias("cascade_id"))
    present = feature_table(spark, folder).select("cascade_id").distinct()
    return splits.same_members(present, every, ["cascade_id"])


@query(
    "label_recount",
    f"""WITH {CASCADES}, r AS (SELECT sequence, count(*) FILTER (t > 900 AND t <= 86400) AS a, count(*) FILTER (t > 3600 AND t <= 86400) AS b FROM asg WHERE NOT is_origin GROUP BY 1)
    SELECT cascade_id, cutoff AS cutoff_seconds, future AS stored, CASE WHEN cutoff = 900 THEN coalesce(a, 0) ELSE coalesce(b, 0) END AS recounted, true AS matches FROM feat LEFT JOIN r USING (sequence)""",
)
def label_recount(spark, folder):
    return ops.label_recount(feature_table(spark, folder), assigned(spark, folder), probes=None)


@query(
    "label_recount_probes",
    f"""WITH {CASCADES}, k AS (SELECT DISTINCT sequence FROM feat ORDER BY sequence LIMIT 100) SELECT cascade_id, cutoff AS cutoff_seconds, future AS stored, future AS recounted, true AS matches FROM feat JOIN k USING (sequence)""",
)
def label_recount_probes(spark, folder):
    return ops.label_recount(feature_table(spark, folder), assigned(spark, folder), probes=100)


@query(
    "label_blind_read",
    f"""WITH {CASCADES} SELECT cascade_id, cutoff AS cutoff_seconds, {R('day')} AS post_time_day, future AS future_retweets_to_24h, total AS total_retweets_at_24h FROM feat WHERE day + 1 <= 7""",
)
def label_blind_read(spark, folder):
    rows = feature_table(spark, folder)
    # As source text, with unreadable labels on every row that may not be used.
    raw = rows.select(
        "cascade_id",
        "cutoff_seconds",
        F.col("post_time_day").cast("string").alias("post_time_day"),
        *[
            F.when(F.col("post_time_day") + 1 <= 7, F.col(c).cast("string")).otherwise("poisoned").alias(c)
            for c in FEATURE_LABELS
        ],
    )
    admitted, _ = splits.label_blind(raw, FEATURE_LABELS)
    return admitted.withColumn("post_time_day", r6("post_time_day"))


@query(
    "label_blind_skips",
    f"WITH {CASCADES} SELECT 'not_training_day' AS reason, count(*) AS n_rows FROM feat WHERE day + 1 > 7",
)
def label_blind_skips(spark, folder):
    raw = feature_table(spark, folder).withColumn("post_time_day", F.col("post_time_day").cast("string"))
    return splits.label_blind(raw, FEATURE_LABELS)[1]


@query(
    "feature_vectors",
    f"""WITH {CASCADES} SELECT cascade_id, cutoff AS cutoff_seconds, {R('ln(1 + observed)')} AS x0, {R('coalesce(first_at / cutoff, 0)')} AS x1, {R('coalesce(last_at / cutoff, 0)')} AS x2,
    CASE WHEN observed = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x3, {R('cutoff / 86400.0::DOUBLE')} AS x4 FROM feat""",
)
def feature_vectors(spark, folder):
    rows = feature_table(spark, folder).select("cascade_id", "cutoff_seconds", ops.feature_vector().alias("x"))
    return rows.select("cascade_id", "cutoff_seconds", *[r6(F.col("x")[i]).alias(f"x{i}") for i in range(5)])


@query(
    "feature_normaliser",
    f"""WITH {CASCADES}, x AS (SELECT cutoff, ln(1 + observed) AS a, coalesce(first_at / cutoff, 0) AS b, cutoff / 86400.0::DOUBLE AS c FROM train)
    SELECT cutoff AS cutoff_seconds, count(*) AS n_fit, {R('avg(a)')} AS log_mean, {R('CASE WHEN stddev_pop(a) = 0 THEN 1 ELSE stddev_pop(a) END')} AS log_scale, {R('avg(b)')} AS first_mean,
    {R('CASE WHEN stddev_pop(b) = 0 THEN 1 ELSE stddev_pop(b) END')} AS first_scale, {R('avg(c)')} AS cutoff_mean, 1.0::DOUBLE AS cutoff_scale FROM x GROUP BY 1""",
)
def feature_normaliser(spark, folder):
    train = feature_table(spark, folder).filter(F.col("strict_label_available_split") == "train_candidate")
    x = train.select("cutoff_seconds", ops.feature_vector().alias("x"))
    rows = metrics.normaliser(x, {"log": F.col("x")[0], "first": F.col("x")[1], "cutoff": F.col("x")[4]}, ["cutoff_seconds"])
    for c in ("log_mean", "log_scale", "first_mean", "first_scale", "cutoff_mean", "cutoff_scale"):
        rows = rows.withColumn(c, r6(c))
    return rows


def baseline_table(spark, folder):
    rows = feature_table(spark, folder)
    split = F.col("strict_label_available_split")
    overall, buckets = metrics.fit_baselines(rows.filter(split == "train_candidate"))
    return metrics.baseline_predictions(rows.filter(split == "evaluation_candidate"), overall, buckets)


@query(
    "bucket_baseline",
    f"""WITH {CASCADES} SELECT cutoff AS cutoff_seconds, CAST(bucket AS BIGINT) AS bucket, {R('bm')} AS bucket_median, bn AS bucket_training_count FROM bmed""",
)
def bucket_baseline(spark, folder):
    train = feature_table(spark, folder).filter(F.col("strict_label_available_split") == "train_candidate")
    _, buckets = metrics.fit_baselines(train)
    return buckets.select(
        "cutoff_seconds", F.col("bucket").cast("bigint").alias("bucket"), r6("bucket_median").alias("bucket_median"), "bucket_training_count"
    )


@query(
    "baseline_predictions",
    f"WITH {CASCADES} SELECT cascade_id, cutoff AS cutoff_seconds, observed AS observed_retweet_count, CASE WHEN observed = 0 THEN 1 ELSE 0 END AS cold_at_cutoff, actual, model, {R('p')} AS prediction FROM long",
)
def baseline_predictions(spark, folder):
    rows = metrics.prediction_rows(baseline_table(spark, folder))
    return rows.withColumn("prediction", r6("prediction"))


METRICS = """count(*) AS n_cascades, {mae} AS mae, {log} AS log1p_mae, {med} AS median_absolute_error, {p90} AS p90_absolute_error, {wape} AS wape,
    CAST(sum(actual) AS DOUBLE) AS sum_actual, {bias} AS bias, {rmse} AS rmse""".format(
    mae=R("avg(abs(p - actual))"),
    log=R("avg(abs(ln(1 + actual) - ln(1 + p)))"),
    med=R("quantile_cont(abs(p - actual), 0.5)"),
    p90=R("quantile_cont(abs(p - actual), 0.9)"),
    wape=R("sum(abs(p - actual)) / nullif(sum(actual), 0)"),
    bias=R("avg(p - actual)"),
    rmse=R("sqrt(avg((p - actual) * (p - actual)))"),
)


def rounded_metrics(rows):
    for c in ("mae", "log1p_mae", "median_absolute_error", "p90_absolute_error", "wape", "rmse"):
        rows = rows.withColumn(c, r6(c))
    return rows.withColumn("bias", r6("bias_predicted_minus_actual")).drop("bias_predicted_minus_actual")


@query("count_metrics", f"WITH {CASCADES} SELECT cutoff AS cutoff_seconds, model, {METRICS} FROM long GROUP BY 1, 2")
def count_metrics(spark, folder):
    rows = metrics.prediction_rows(baseline_table(spark, folder))
    return rounded_metrics(metrics.count_metrics(rows, ["cutoff_seconds", "model"]))


STRATA = """st AS (SELECT *, 'all' AS stratum FROM long UNION ALL SELECT *, CASE WHEN observed = 0 THEN 'cold_at_cutoff' ELSE 'warm_at_cutoff' END FROM long UNION ALL SELECT *, 'zero_target' FROM long WHERE actual = 0)"""


@query("strata_metrics", f"WITH {CASCADES}, {STRATA} SELECT cutoff AS cutoff_seconds, model, stratum, {METRICS} FROM st GROUP BY 1, 2, 3")
def strata_metrics(spark, folder):
    rows = metrics.strata(metrics.prediction_rows(baseline_table(spark, folder)), "observed_retweet_count", "actual")
    return rounded_metrics(metrics.count_metrics(rows, ["cutoff_seconds", "model", "stratum"]))


@query(
    "exact_quantiles",
    f"""WITH {CASCADES} SELECT model, {R('quantile_cont(abs(p - actual), 0.5)')} AS q50, {R('quantile_cont(abs(p - actual), 0.9)')} AS q90 FROM long GROUP BY 1""",
)
def exact_quantiles(spark, folder):
    """The bracketed form that large groups use, forced on every group."""
    from ..operators.ordered import exact_quantiles as quantiles

    rows = metrics.prediction_rows(baseline_table(spark, folder)).withColumn("e", F.abs(F.col("prediction") - F.col("actual")))
    out = quantiles(rows, ["model"], "e", {"q50": 0.5, "q90": 0.9})
    return out.select("model", r6("q50").alias("q50"), r6("q90").alias("q90"))


def interval_rows(spark, folder):
    """Half and double of the bucket median as interval bounds."""
    rows = baseline_table(spark, folder)
    p = F.col("train_log_count_bucket_median")
    return rows.select(
        "cascade_id",
        "cutoff_seconds",
        "observed_retweet_count",
        F.col("future_retweets_to_24h").alias("actual"),
        (p * 0.5).alias("lower"),
        p.alias("median"),
        (p * 2.0).alias("upper"),
    )


@query(
    "interval_coverage",
    f"""WITH {CASCADES}, {STRATA} SELECT cutoff AS cutoff_seconds, stratum, count(*) AS n, {R('avg(CASE WHEN actual BETWEEN p * 0.5::DOUBLE AND p * 2 THEN 1.0::DOUBLE ELSE 0 END)')} AS coverage, {R('avg(p * 2 - p * 0.5::DOUBLE)')} AS width
    FROM st WHERE model = 'train_log_count_bucket_median' GROUP BY 1, 2""",
)
def interval_coverage(spark, folder):
    rows = metrics.strata(interval_rows(spark, folder), "observed_retweet_count", "actual")
    out = metrics.interval_metrics(rows, ["cutoff_seconds", "stratum"])
    return out.select(
        "cutoff_seconds",
        "stratum",
        "n",
        r6("interval_80_empirical_coverage").alias("coverage"),
        r6("interval_80_mean_width").alias("width"),
    )


@query(
    "pinball_loss",
    f"""WITH {CASCADES}, x AS (SELECT cutoff, actual - p * 0.5::DOUBLE AS a, actual - p AS b, actual - p * 2 AS c FROM long WHERE model = 'train_log_count_bucket_median')
    SELECT cutoff AS cutoff_seconds, {R('avg((greatest(0.1::DOUBLE * a, -0.9::DOUBLE * a) + greatest(0.5::DOUBLE * b, -0.5::DOUBLE * b) + greatest(0.9::DOUBLE * c, -0.1::DOUBLE * c)) / 3)')} AS pinball_loss FROM x GROUP BY 1""",
)
def pinball_loss(spark, folder):
    out = metrics.pinball_loss(
        interval_rows(spark, folder),
        ["cutoff_seconds"],
        F.col("actual"),
        {0.1: F.col("lower"), 0.5: F.col("median"), 0.9: F.col("upper")},
    )
    return out.withColumn("pinball_loss", r6("pinball_loss"))


@query(
    "quantile_order",
    f"""WITH {CASCADES} SELECT cascade_id, cutoff AS cutoff_seconds, p >= 0 AND p <= p * 2 AND p <= observed AS ordered FROM long WHERE model = 'train_log_count_bucket_median'""",
)
def quantile_order(spark, folder):
    rows = interval_rows(spark, folder)
    ordered = numeric.quantiles_ordered(F.col("lower"), F.col("median"), F.col("observed_retweet_count"))
    return rows.select("cascade_id", "cutoff_seconds", ordered.alias("ordered"))


@query(
    "matched_comparison",
    f"""WITH {CASCADES}, m AS (SELECT cutoff, model, count(*) AS n, avg(abs(p - actual)) AS mae FROM long GROUP BY 1, 2)
    SELECT a.cutoff AS cutoff_seconds, a.n AS n_cascades, {R('a.mae')} AS baseline_mae, {R('b.mae')} AS model_mae, {R('(a.mae - b.mae) / a.mae')} AS mae_reduction_ratio
    FROM m a JOIN m b USING (cutoff) WHERE a.model = 'constant_train_median' AND b.model = 'train_log_count_bucket_median'""",
)
def matched_comparison(spark, folder):
    table = metrics.count_metrics(metrics.prediction_rows(baseline_table(spark, folder)), ["cutoff_seconds", "model"])
    rows = metrics.matched_comparison(table, "constant_train_median", "train_log_count_bucket_median", ["cutoff_seconds"])
    return rows.select(
        "cutoff_seconds",
        "n_cascades",
        r6("baseline_mae").alias("baseline_mae"),
        r6("model_mae").alias("model_mae"),
        r6("mae_reduction_ratio").alias("mae_reduction_ratio"),
    )


@query(
    "candidate_choice",
    f"""WITH {CASCADES}, m AS (SELECT cutoff, model, avg(abs(p - actual)) AS mae FROM long GROUP BY 1, 2) SELECT cutoff AS cutoff_seconds, arg_min(model, (mae, CASE model WHEN 'zero_additional_keep_last_count' THEN 0 WHEN 'constant_train_median' THEN 1
      WHEN 'early_constant_rate' THEN 2 ELSE 3 END)) AS selected_model, {R('min(mae)')} AS mae FROM m GROUP BY 1""",
)
def candidate_choice(spark, folder):
    table = metrics.count_metrics(metrics.prediction_rows(baseline_table(spark, folder)), ["cutoff_seconds", "model"])
    out = metrics.choose_candidate(table, ["cutoff_seconds"], "mae", metrics.BASELINES)
    return out.withColumn("mae", r6("mae"))


# --- fits (no SQL form) -----------------------------------------------------------------------


def kept_features(spark, folder):
    """Feature rows written once to the checkpoint folder, as every epoch reads them again.

    They are small, but each is scored by networks: so they lie in as many parts as there are cores.
    """
    from ..session import cut_lineage, spread

    return spread(cut_lineage(feature_table(spark, folder)), "cascade_id")


@query("cascade_fit")
def cascade_fit(spark, folder):
    tables = reports.cascade_benchmark(kept_features(spark, folder))
    return tables["metrics"]


@query("cascade_fit_parity")
def cascade_fit_parity(spark, folder):
    rows = fitting.training_rows(kept_features(spark, folder), 900)
    model = fitting.fit_network(rows, "count", 3, fit_part=F.lit(True))
    return fitting.score_parity(rows, model)


@query("quantile_fit")
def quantile_fit(spark, folder):
    rows = kept_features(spark, folder)
    return reports.cascade_quantiles(rows)["metrics"]

"""Queries over the labelled text corpus, scores and origin predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import links, numeric, text, times
from ..operators import answers, leakage, metrics, splits, validation
from ..plans import fitting, reports
from ..session import cut_lineage, spread
from ..sources.readers import manifest_diff as compare_manifests
from .registry import R, query, r6, table, us
from .views import BASE, COMPONENTS, DAY, N, QA, SCORES, SEED, events, questions, scores

# --- text -------------------------------------------------------------------------------------


def normal_documents(spark, folder):
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", text.normalise("text").alias("text"))


@query(
    "text_normalise",
    f"SELECT doc_id, sha256({N('text')}) AS fingerprint, length({N('text')}) AS n_codepoints FROM documents",
)
def text_normalise(spark, folder):
    return normal_documents(spark, folder).select(
        "doc_id", text.fingerprint(F.col("text")).alias("fingerprint"), F.length("text").cast("bigint").alias("n_codepoints")
    )


@query(
    "text_groups",
    f"""WITH t AS (SELECT doc_id, {N('text')} AS x FROM documents), c AS (SELECT doc_id, length(x) AS n, length(regexp_replace(x, '[^㐀-鿿]', '', 'g')) AS cjk,
    length(regexp_replace(x, '[^\\p{{L}}]', '', 'g')) AS letters FROM t)
    SELECT doc_id, letters AS n_letters, concat_ws(',', CASE WHEN cjk > 0 THEN 'contains_cjk' ELSE 'no_cjk' END, CASE WHEN letters > 0 AND cjk / letters::DOUBLE >= 0.5 THEN 'predominantly_cjk_letters' END,
    CASE WHEN n <= 280 THEN 'short_le280_codepoints' ELSE 'long_gt280_codepoints' END, CASE WHEN cjk > 0 AND n > 280 THEN 'inference_supported_long_cjk' END) AS groups FROM c""",
)
def text_groups(spark, folder):
    return normal_documents(spark, folder).select(
        "doc_id",
        text.letter_count(F.col("text")).cast("bigint").alias("n_letters"),
        F.array_join(text.text_groups(F.col("text")), ",").alias("groups"),
    )


@query("hash_features")
def hash_features(spark, folder):
    rows = normal_documents(spark, folder).select("doc_id", text.hashed_features("text").alias("f"))
    return rows.select(
        "doc_id",
        F.size("f.indices").alias("n_buckets"),
        r6(F.aggregate("f.values", F.lit(0.0), lambda s, v: s + v * v)).alias("squared_length"),
    )


@query(
    "decision_gate",
    f"""WITH t AS (SELECT doc_id, {N('text')} AS x, CASE WHEN doc_id % 7 = 0 THEN 'three_class' ELSE 'binary' END AS task, CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE 'open_qa' END AS domain FROM documents)
    SELECT doc_id, CASE WHEN task <> 'binary' THEN 'mixed_and_three_class_origin_not_trained' WHEN domain <> 'open_qa' THEN 'out_of_domain_or_unvalidated_content' WHEN length(x) <= 280 THEN 'short_text_not_validated_for_deployment'
    WHEN NOT regexp_matches(x, '[㐀-鿿]') THEN 'non_Chinese_content_not_validated_for_deployment' END AS reason FROM t""",
)
def decision_gate(spark, folder):
    task = F.when(F.col("doc_id") % 7 == 0, "three_class").otherwise("binary")
    domain = F.when(F.col("doc_id") % 3 == 0, "other").otherwise("open_qa")
    return normal_documents(spark, folder).select(
        "doc_id", text.decision_gate(F.col("text"), domain, task, "open_qa").alias("reason")
    )


# --- question and answer corpus ---------------------------------------------------------------


def occurrence_rows(spark, folder):
    return answers.occurrences(questions(spark, folder))


@query(
    "answer_occurrences",
    f"WITH {QA} SELECT CAST(label AS INTEGER) AS label, CASE WHEN text = '' THEN 'empty_answer' ELSE 'usable' END AS state, count(*) AS n_occurrences FROM occ GROUP BY 1, 2",
)
def answer_occurrences(spark, folder):
    return answers.occurrence_counts(occurrence_rows(spark, folder))


@query(
    "dedupe_answers",
    f"""WITH {QA} SELECT answer_sha256, n AS n_occurrences, CASE WHEN lo <> hi THEN NULL ELSE lo END AS label,
    CASE WHEN lo <> hi THEN 'conflicting_labels' WHEN n > 1 THEN 'same_label_duplicates' ELSE 'single' END AS status FROM ans""",
)
def dedupe_answers(spark, folder):
    rows = answers.answer_status(occurrence_rows(spark, folder))
    label = F.when(F.col("status") != "conflicting_labels", F.col("label"))
    return rows.select("answer_sha256", "n_occurrences", label.alias("label"), "status")


@query("components", f"WITH RECURSIVE {COMPONENTS} SELECT grp AS \"group\", group_id FROM comp")
def components(spark, folder):
    return answers.question_groups(occurrence_rows(spark, folder))


SPLIT = f"""{COMPONENTS}, kept AS (SELECT a.*, c.group_id FROM ans a JOIN comp c USING (grp) WHERE lo = hi),
gr AS (SELECT DISTINCT group_id FROM kept), od AS (SELECT group_id, row_number() OVER (ORDER BY sha256('{SEED}:' || group_id)) - 1 AS i, count(*) OVER () AS n FROM gr),
sp AS (SELECT group_id, CASE WHEN i < CAST(floor(n * 0.70::DOUBLE) AS BIGINT) THEN 'train' WHEN i < CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM od)"""


def split_rows(spark, folder, with_text=False):
    return reports.origin_dataset(questions(spark, folder), SEED, with_text)["rows"]


@query("group_split", f"WITH RECURSIVE {SPLIT} SELECT answer_sha256, group_id, CAST(lo AS INTEGER) AS label, split FROM kept JOIN sp USING (group_id)")
def group_split(spark, folder):
    return split_rows(spark, folder).select("answer_sha256", "group_id", "label", "split")


@query(
    "split_summary",
    f"""WITH RECURSIVE {SPLIT}, g AS (SELECT split, group_id, count(*) AS n, sum(lo) AS n1 FROM kept JOIN sp USING (group_id) GROUP BY 1, 2)
    SELECT split, CAST(sum(n) AS BIGINT) AS answers, count(*) AS n_groups, CAST(sum(n) - sum(n1) AS BIGINT) AS human_written, CAST(sum(n1) AS BIGINT) AS ai_generated, max(n) AS largest_group_answers FROM g GROUP BY 1""",
)
def split_summary(spark, folder):
    return answers.split_summary(split_rows(spark, folder))


@query(
    "occurrence_coverage",
    f"""WITH RECURSIVE {SPLIT} SELECT (SELECT count(*) FROM occ) AS n_occurrences, count(*) AS n_retained, {R('count(*) / (SELECT count(*) FROM occ)::DOUBLE')} AS coverage FROM kept""",
)
def occurrence_coverage(spark, folder):
    return reports.origin_dataset(questions(spark, folder), SEED, with_text=False)["coverage"].withColumn("coverage", r6("coverage"))


@query("straddling_groups", f"WITH RECURSIVE {SPLIT} SELECT group_id FROM kept JOIN sp USING (group_id) GROUP BY 1 HAVING count(DISTINCT split) > 1")
def straddling_groups(spark, folder):
    return splits.straddling_groups(split_rows(spark, folder), "group_id")


@query(
    "document_hash_split",
    f"""WITH od AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('{SEED}:' || doc_id)) - 1 AS i, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN i < CAST(floor(n * 0.70::DOUBLE) AS BIGINT) THEN 'train' WHEN i < CAST(floor(n * 0.85::DOUBLE) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM od""",
)
def document_hash_split(spark, folder):
    return splits.hash_split(table(spark, folder, "documents"), "doc_id", SEED)


# --- classifier fits (no SQL form) ------------------------------------------------------------


@query("origin_fit")
def origin_fit(spark, folder):
    # Hashing costs far more than the bytes by which adaptive execution sizes its partitions.
    rows = spread(cut_lineage(split_rows(spark, folder, with_text=True)), "answer_sha256")
    return reports.origin_benchmark(rows)["metrics"]


@query("length_fit")
def length_fit(spark, folder):
    rows = cut_lineage(split_rows(spark, folder, with_text=True)).withColumn("part", F.col("split"))
    sparse = fitting.length_features(rows)
    model = fitting.fit_logistic(sparse.filter(F.col("part") != "test"), 1)
    test = sparse.filter(F.col("part") == "test").withColumn("logit", model.logit_udf()("indices", "values"))
    return test.select("answer_sha256", r6("logit").alias("logit"))


# --- scores -----------------------------------------------------------------------------------


@query(
    "tie_ranks",
    f"""WITH {SCORES}, r AS (SELECT toxic, p, label, rank() OVER (PARTITION BY toxic ORDER BY p) + (count(*) OVER (PARTITION BY toxic, p) - 1) / 2.0::DOUBLE AS average_rank FROM sc)
    SELECT toxic, p AS score, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_positive, max(average_rank) AS average_rank FROM r GROUP BY 1, 2""",
)
def tie_ranks(spark, folder):
    return metrics.tie_ranks(scores(spark, folder), ["toxic"])


@query(
    "auroc",
    f"""WITH {SCORES}, r AS (SELECT toxic, label, rank() OVER (PARTITION BY toxic ORDER BY p) + (count(*) OVER (PARTITION BY toxic, p) - 1) / 2.0::DOUBLE AS k FROM sc),
    s AS (SELECT toxic, sum(k) FILTER (label = 1) AS r, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS b FROM r GROUP BY 1) SELECT toxic, {R('(r - a * (a + 1) / 2) / nullif(a * b, 0)')} AS auroc FROM s""",
)
def auroc(spark, folder):
    return metrics.auroc(scores(spark, folder), ["toxic"]).withColumn("auroc", r6("auroc"))


@query(
    "binary_metrics",
    f"""WITH {SCORES}, c AS (SELECT toxic, count(*) AS n, count(*) FILTER (label = 1 AND guess = 1) AS tp, count(*) FILTER (label = 0 AND guess = 0) AS tn, count(*) FILTER (label = 0 AND guess = 1) AS fp,
      count(*) FILTER (label = 1 AND guess = 0) AS fn, avg((p - label) * (p - label)) AS brier, avg(-ln(greatest(1e-15::DOUBLE, CASE WHEN label = 1 THEN p ELSE 1 - p END))) AS nll FROM sl GROUP BY 1)
    SELECT toxic, n, tp, tn, fp, fn, {R('(tp + tn) / n::DOUBLE')} AS accuracy, {R('2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE')} AS f1_ai,
    {R('(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE + 2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE) / 2')} AS f1_macro, {R('brier')} AS brier, {R('nll')} AS nll, n < 30 AS small_group FROM c""",
)
def binary_metrics(spark, folder):
    rows = metrics.binary_metrics(scores(spark, folder), ["toxic"])
    return rows.select(
        "toxic", "n", "tp", "tn", "fp", "fn", r6("accuracy").alias("accuracy"), r6("f1_ai").alias("f1_ai"), r6("f1_macro").alias("f1_macro"),
        r6("brier").alias("brier"), r6("negative_log_likelihood").alias("nll"), "small_group",
    )


BINS = f"""{SCORES}, cf AS (SELECT toxic, CASE WHEN guess = 1 THEN p ELSE 1 - p END AS c, CASE WHEN guess = label THEN 1.0::DOUBLE ELSE 0 END AS hit FROM sl),
bn AS (SELECT toxic, least(9, CAST(floor(c * 10) AS INTEGER)) AS bin, count(*) AS n, avg(hit) AS acc, avg(c) AS conf FROM cf GROUP BY 1, 2)"""


@query(
    "reliability_bins",
    f"""WITH {BINS}, f AS (SELECT toxic, CAST(unnest(range(10)) AS INTEGER) AS bin FROM (SELECT DISTINCT toxic FROM sc)) SELECT toxic, bin, {R('bin / 10.0::DOUBLE')} AS lower, {R('(bin + 1) / 10.0::DOUBLE')} AS upper,
    coalesce(n, 0) AS n, {R('acc')} AS accuracy, {R('conf')} AS mean_confidence FROM f LEFT JOIN bn USING (toxic, bin)""",
)
def reliability_bins(spark, folder):
    rows = metrics.reliability(scores(spark, folder), ["toxic"])
    for c in ("lower", "upper", "accuracy", "mean_confidence"):
        rows = rows.withColumn(c, r6(c))
    return rows


@query("calibration_error", f"WITH {BINS} SELECT toxic, {R('sum(n * abs(acc - conf)) / sum(n)')} AS ece FROM bn GROUP BY 1")
def calibration_error(spark, folder):
    bins = metrics.reliability(scores(spark, folder), ["toxic"])
    return metrics.calibration_error(bins, ["toxic"]).withColumn("ece", r6("ece"))


GRID = f"""{SCORES}, g AS (SELECT toxic, t, avg(greatest(logit / t, 0) - label * logit / t + ln(1 + exp(-abs(logit / t)))) AS nll
    FROM sl, (SELECT unnest([0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0, 8.0])::DOUBLE AS t) GROUP BY 1, 2)"""


@query("nll_grid", f"WITH {GRID} SELECT toxic, t AS temperature, {R('nll')} AS nll FROM g")
def nll_grid(spark, folder):
    return metrics.temperature_grid(scores(spark, folder), ["toxic"]).withColumn("nll", r6("nll"))


@query("temperature_choice", f"WITH {GRID} SELECT toxic, arg_min(t, (nll, abs(ln(t)), t)) AS temperature, {R('min(nll)')} AS nll FROM g GROUP BY 1")
def temperature_choice(spark, folder):
    grid = metrics.temperature_grid(scores(spark, folder), ["toxic"])
    return metrics.choose_temperature(grid, ["toxic"]).select("toxic", "temperature", r6("nll").alias("nll"))


@query(
    "calibration_report",
    f"""WITH {SCORES}, c AS (SELECT label, 'calibrated' AS model, 1 / (1 + exp(-logit / 2)) AS p FROM sl UNION ALL SELECT label, 'uncalibrated', 1 / (1 + exp(-logit)) FROM sl)
    SELECT model, count(*) AS n, {R('avg((p - label) * (p - label))')} AS brier, {R('avg(-ln(greatest(1e-15::DOUBLE, CASE WHEN label = 1 THEN p ELSE 1 - p END)))')} AS nll FROM c GROUP BY 1""",
)
def calibration_report(spark, folder):
    base = scores(spark, folder)
    rows = base.select("label", F.lit("calibrated").alias("model"), numeric.sigmoid(F.col("logit") / 2).alias("probability")).unionByName(
        base.select("label", F.lit("uncalibrated").alias("model"), numeric.sigmoid(F.col("logit")).alias("probability"))
    )
    out = metrics.binary_metrics(rows, ["model"])
    return out.select("model", "n", r6("brier").alias("brier"), r6("negative_log_likelihood").alias("nll"))


@query(
    "subgroup_metrics",
    f"""WITH {SCORES}, t AS (SELECT s.*, length({N('d.text')}) AS n FROM sl s JOIN documents d USING (doc_id)), g AS (SELECT *, unnest(['all', 'no_cjk', CASE WHEN n <= 280 THEN 'short_le280_codepoints' ELSE 'long_gt280_codepoints' END]) AS text_group FROM t)
    SELECT text_group, count(*) AS n, {R('avg(CASE WHEN guess = label THEN 1.0::DOUBLE ELSE 0 END)')} AS accuracy, {R('avg((p - label) * (p - label))')} AS brier FROM g GROUP BY 1""",
)
def subgroup_metrics(spark, folder):
    rows = scores(spark, folder).join(normal_documents(spark, folder), "doc_id").withColumn("model", F.lit("score"))
    out = reports.subgroup_metrics(rows)
    return out.select("text_group", "n", r6("accuracy").alias("accuracy"), r6("brier").alias("brier"))


@query(
    "label_coverage",
    f"""SELECT lang, count(*) AS n_rows, count(l.doc_id) AS n_flagged, {R('count(l.doc_id) / count(*)::DOUBLE')} AS label_coverage FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
)
def label_coverage(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    labelled = table(spark, folder, "labels").select("doc_id", F.lit(True).alias("_l"))
    rows = docs.join(labelled, "doc_id", "left")
    out = metrics.coverage_share(rows, F.col("_l").isNotNull(), ["lang"], "label_coverage")
    return out.withColumn("label_coverage", r6("label_coverage"))


# --- origin predictions -----------------------------------------------------------------------

ORIGIN = """op AS (SELECT doc_id, quality, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE a / t::DOUBLE END AS ph, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE b / t::DOUBLE END AS pa,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE c / t::DOUBLE END AS pm FROM (SELECT *, a + b + c AS t FROM (SELECT doc_id, quality, doc_id % 5 AS a, (doc_id * 3 + quality) % 7 AS b, doc_id % 3 + 1 AS c FROM labels)))"""


def origin_predictions(spark, folder):
    """Three-class predictions for every labelled document, with their clocks."""
    labels = table(spark, folder, "labels")
    i = F.col("doc_id")
    parts = {"human_written": i % 5, "ai_generated": (i * 3 + F.col("quality")) % 7, "mixed": i % 3 + 1}
    total = i % 5 + (i * 3 + F.col("quality")) % 7 + i % 3 + 1
    at = F.timestamp_micros(i * 60000000 + BASE)
    return labels.select(
        i.alias("prediction_id"),
        "quality",
        F.lit("x").alias("platform"),
        (i + 1).cast("string").alias("post_id"),
        F.lit("v1").alias("post_version"),
        F.lit(None).cast("string").alias("post_url"),
        *[F.when(i % 11 != 0, p / total).alias(f"p_{c}") for c, p in parts.items()],
        F.when(i % 11 != 0, "external").alias("model_id"),
        F.lit(None).cast("string").alias("weights_sha256"),
        at.alias("published_at"),
        F.lit(None).cast("timestamp").alias("captured_at"),
        F.timestamp_micros(F.unix_micros(at) + DAY).alias("generated_at"),
        F.timestamp_micros(F.unix_micros(at) + DAY + F.when(i % 13 == 0, 3 * DAY).otherwise(60000000)).alias("available_at"),
        F.timestamp_micros(F.unix_micros(at) + 2 * DAY).alias("prediction_at"),
        F.lit(None).cast("timestamp").alias("downstream_at"),
        F.when(i % 4 != 0, F.concat(F.lit("g"), i % 50)).alias("content_group_id"),
        F.when(i % 6 == 0, "in_sample").when(i % 6 == 1, "out_of_fold").otherwise("chronological").alias("strategy"),
        F.when(i % 12 == 1, "fold").alias("fold_id"),
        F.timestamp_micros(F.unix_micros(at) - DAY).alias("training_cutoff"),
        F.timestamp_micros(F.unix_micros(at)).alias("trained_at"),
    )


@query(
    "entropy_argmax",
    f"""WITH {ORIGIN} SELECT doc_id AS prediction_id, {R('-(CASE WHEN ph > 0 THEN ph * ln(ph) ELSE 0 END + CASE WHEN pa > 0 THEN pa * ln(pa) ELSE 0 END + CASE WHEN pm > 0 THEN pm * ln(pm) ELSE 0 END) / ln(3) + CASE WHEN ph IS NULL THEN NULL ELSE 0 END')} AS normalized_entropy,
    CASE WHEN ph IS NULL THEN 'unknown' WHEN ph > pa AND ph > pm THEN 'human_written' WHEN pa > ph AND pa > pm THEN 'ai_generated' WHEN pm > ph AND pm > pa THEN 'mixed' ELSE 'unknown' END AS estimated_content_origin FROM op""",
)
def entropy_argmax(spark, folder):
    rows = leakage.estimates(origin_predictions(spark, folder))
    return rows.select("prediction_id", r6("normalized_entropy").alias("normalized_entropy"), "estimated_content_origin")


@query(
    "brier_logloss",
    f"""WITH {ORIGIN}, x AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'unknown' WHEN quality = 1 THEN 'ai_generated' ELSE 'human_written' END AS truth, CASE WHEN quality = 1 THEN pa ELSE ph END AS pt FROM op)
    SELECT doc_id AS prediction_id, truth AS content_origin, CASE WHEN ph IS NULL THEN 'unavailable_prediction' WHEN truth = 'unknown' THEN 'unknown_label' ELSE 'descriptive_evaluation' END AS status,
    CASE WHEN truth <> 'unknown' THEN {R("(ph - CASE WHEN truth = 'human_written' THEN 1 ELSE 0 END)^2 + (pa - CASE WHEN truth = 'ai_generated' THEN 1 ELSE 0 END)^2 + pm^2")} END AS brier,
    CASE WHEN truth <> 'unknown' AND pt > 0 THEN {R('-ln(pt)')} END AS log_loss, CASE WHEN truth <> 'unknown' AND pt = 0 THEN 'infinite_for_zero_target_probability' END AS log_loss_reason FROM x
    WHERE {BASE} + doc_id * 60000000 + 2 * {DAY} <= {BASE} + 3 * {DAY}""",
)
def brier_logloss(spark, folder):
    predictions = origin_predictions(spark, folder)
    truth = F.when(F.col("prediction_id") % 10 == 0, "unknown").when(F.col("quality") == 1, "ai_generated").otherwise("human_written")
    labels = predictions.select(
        "platform", "post_id", "post_version", truth.alias("content_origin"), F.col("prediction_at").alias("label_available_at")
    )
    rows = leakage.evaluate_origin(predictions, labels, F.timestamp_micros(F.lit(BASE + 3 * DAY)))
    return rows.select("prediction_id", "content_origin", "status", r6("brier").alias("brier"), r6("log_loss").alias("log_loss"), "log_loss_reason")


@query(
    "simplex_check",
    f"WITH {ORIGIN} SELECT doc_id AS prediction_id, ph IS NOT NULL AND doc_id % 9 <> 0 AS simplex FROM op",
)
def simplex_check(spark, folder):
    bump = F.when(F.col("prediction_id") % 9 == 0, 0.001).otherwise(0.0)
    ps = [F.col("p_human_written") + bump, F.col("p_ai_generated"), F.col("p_mixed")]
    return origin_predictions(spark, folder).select("prediction_id", numeric.simplex_ok(ps).alias("simplex"))


@query(
    "prediction_rejects",
    f"""WITH {ORIGIN} SELECT doc_id AS prediction_id, 'prediction_clock_order' AS rule FROM op WHERE ph IS NOT NULL AND doc_id % 13 = 0""",
)
def prediction_rejects(spark, folder):
    _, bad = validation.split(origin_predictions(spark, folder), leakage.prediction_rules())
    return bad.select("prediction_id", "rule")


def input_features(spark, folder):
    """Events as input features of the labelled documents, by user number."""
    kind = F.col("event_type")
    return events(spark, folder).select(
        (F.col("user_id") + 1).alias("prediction_id"),
        "event_id",
        F.when(kind == "error", "label").otherwise(F.concat(kind, F.lit("_"), F.col("event_id"))).alias("name"),
        F.when(kind == "click", "comments").when(kind == "view", "text").otherwise("metadata").alias("kind"),
        F.when(F.col("event_id") % 17 == 0, "v0").otherwise("v1").alias("version"),
        F.col("observed_at").alias("captured_at"),
        F.timestamp_micros(F.unix_micros("observed_at") + F.col("event_id") % 4 * DAY).alias("available_at"),
        F.when((kind == "click") & (F.col("event_id") % 2 == 0), F.timestamp_micros(F.unix_micros("observed_at") - 1000000)).alias("latest_event_at"),
    )


FEATURES = f"""fe AS (SELECT user_id + 1 AS pid, event_id, event_type, epoch_us(ts) AS cap, epoch_us(ts) + (event_id % 4) * {DAY} AS av,
    {BASE} + (user_id + 1) * 60000000 + 10 * {DAY} AS cut FROM events WHERE user_id + 1 IN (SELECT doc_id FROM labels))"""


@query(
    "point_in_time",
    f"""WITH {FEATURES} SELECT pid AS prediction_id, event_id, CASE WHEN event_type = 'error' THEN 'feature_is_a_label' WHEN event_id % 17 = 0 THEN 'feature_version'
    WHEN av > cut THEN 'late_capture_or_availability' WHEN event_type = 'click' AND event_id % 2 <> 0 THEN 'comments_need_latest_event' END AS rule FROM fe""",
)
def point_in_time(spark, folder):
    predictions = origin_predictions(spark, folder).select(
        "prediction_id", "post_version", F.timestamp_micros(F.unix_micros("published_at") + 10 * DAY).alias("generated_at")
    )
    rows = leakage.admit_features(input_features(spark, folder), predictions)
    return rows.select("prediction_id", "event_id", "rule")


def training_posts(spark, folder):
    """Orders as declared training posts of the labelled documents."""
    o = table(spark, folder, "orders")
    pid = F.col("o_custkey")
    start = pid * 60000000 + BASE
    return o.select(
        pid.alias("prediction_id"),
        F.lit("x").alias("platform"),
        F.when(F.col("o_orderkey") % 29 == 0, pid + 1).otherwise(F.col("o_orderkey") + 1000000).cast("string").alias("post_id"),
        F.timestamp_micros(start - F.when(F.col("o_orderkey") % 31 == 0, -DAY).otherwise(5 * DAY)).alias("published_at"),
        F.timestamp_micros(start - F.when(F.col("o_orderkey") % 31 == 0, -DAY).otherwise(4 * DAY)).alias("latest_input_available_at"),
        F.timestamp_micros(start - 3 * DAY).alias("label_available_at"),
        F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("h"), F.col("o_orderkey") % 50)).alias("content_group_id"),
    )


@query(
    "leak_check",
    """WITH p AS (SELECT doc_id AS k, doc_id % 6 AS s, doc_id % 12 AS f, CASE WHEN doc_id % 4 <> 0 THEN 'g' || (doc_id % 50) END AS g FROM labels),
    t AS (SELECT o_custkey AS k, count(*) AS n, bool_or(o_orderkey % 29 = 0) AS seen, count(*) FILTER (o_orderkey % 29 = 0) AS dup, bool_or(o_orderkey % 31 = 0) AS future, bool_and(o_orderkey % 7 <> 0) AS groups FROM orders GROUP BY 1),
    j AS (SELECT p.*, coalesce(n, 0) AS n, seen, future, groups, CASE WHEN s = 1 AND f <> 1 THEN 'fold_id_missing' WHEN n IS NULL THEN 'training_groups_missing' WHEN dup > 1 THEN 'training_groups_repeated' WHEN future THEN 'future_training_material' END AS rule FROM p LEFT JOIN t USING (k))
    SELECT k AS prediction_id, rule, n AS training_group_count, NOT seen AS target_declared_post_id_excluded, g IS NOT NULL AND coalesce(groups, false) AS declared_content_groups_complete,
    coalesce(rule IS NULL AND s <> 0 AND NOT seen, false) AS auxiliary_eligible, coalesce(rule IS NULL AND s <> 0 AND NOT seen AND g IS NOT NULL AND groups, false) AS strict_cross_post_eligible FROM j""",
)
def leak_check(spark, folder):
    rows = leakage.training_audit(origin_predictions(spark, folder), training_posts(spark, folder))
    return rows.drop("target_declared_content_group_excluded")


@query(
    "soft_features",
    f"""WITH {ORIGIN}, t AS (SELECT o_custkey AS k, bool_or(o_orderkey % 29 = 0) AS seen, count(*) FILTER (o_orderkey % 29 = 0) AS dup, bool_or(o_orderkey % 31 = 0) AS future FROM orders GROUP BY 1)
    SELECT doc_id AS prediction_id, {BASE} + doc_id * 60000000 + 2 * {DAY} AS downstream_us, {R('ph')} AS authorship_p_human_written, ph IS NULL AS authorship_missing FROM op JOIN t ON t.k = op.doc_id
    WHERE doc_id % 6 <> 0 AND NOT (doc_id % 6 = 1 AND doc_id % 12 <> 1) AND NOT seen AND NOT future AND doc_id % 13 <> 0""",
)
def soft_features(spark, folder):
    predictions = origin_predictions(spark, folder)
    audits = leakage.training_audit(predictions, training_posts(spark, folder))
    rows = leakage.soft_features(predictions, audits)
    return rows.select(
        "prediction_id", us("downstream_at").alias("downstream_us"), r6("authorship_p_human_written").alias("authorship_p_human_written"), "authorship_missing"
    )


@query(
    "origin_label_rules",
    """SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'label_scope' WHEN quality = 1 AND doc_id % 5 = 0 THEN 'evidence_required' WHEN doc_id % 7 = 0 THEN 'evidence_method' END AS rule FROM labels
    WHERE doc_id % 8 = 0 OR (quality = 1 AND doc_id % 5 = 0) OR (doc_id % 7 = 0 AND doc_id % 5 <> 0)""",
)
def origin_label_rules(spark, folder):
    i = F.col("doc_id")
    at = F.timestamp_micros(F.lit(BASE))
    proof = F.array(
        F.struct(
            F.when(i % 7 == 0, "style_guess").otherwise("author_disclosure").alias("method"),
            F.lit("note").alias("reference"),
            at.alias("available_at"),
        )
    )
    labels = table(spark, folder, "labels").select(
        "doc_id",
        F.when(i % 8 == 0, "account").otherwise("text.body").alias("scope"),
        F.lit("policy").alias("label_policy"),
        F.when(F.col("quality") == 1, "ai_generated").otherwise("unknown").alias("content_origin"),
        at.alias("label_available_at"),
        F.when(i % 5 == 0, F.filter(proof, lambda e: F.lit(False))).otherwise(proof).alias("evidence"),
    )
    _, bad = validation.split(labels, leakage.label_rules())
    return bad.select("doc_id", "rule")


# --- source checks ----------------------------------------------------------------------------


@query(
    "json_quarantine",
    """WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 1 THEN replace(props, '}', ', "k": 1}') WHEN 2 THEN replace(props, '}', ', "x": NaN}') WHEN 3 THEN replace(props, '"k": ', '"k": -') ELSE props END AS raw, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, event_id % 5 NOT IN (1, 2) AS strict_json, CASE WHEN event_id % 5 IN (0, 4) OR (event_id % 5 = 3 AND k = 0) THEN k END AS count FROM r""",
)
def json_quarantine(spark, folder):
    case = F.col("event_id") % 5
    raw = (
        F.when(case == 1, F.replace("props", F.lit("}"), F.lit(', "k": 1}')))
        .when(case == 2, F.replace("props", F.lit("}"), F.lit(', "x": NaN}')))
        .when(case == 3, F.replace("props", F.lit('"k": '), F.lit('"k": -')))
        .otherwise(F.col("props"))
    )
    rows = events(spark, folder).select("event_id", raw.alias("raw"))
    strict = F.try_parse_json("raw").isNotNull()
    count = numeric.count_from_text(F.get_json_object("raw", "$.k"))
    return rows.select("event_id", strict.alias("strict_json"), F.when(strict, count).alias("count"))


@query(
    "timestamps_strict",
    """WITH r AS (SELECT event_id, epoch_us(ts) AS us FROM events) SELECT event_id, CASE event_id % 6 WHEN 0 THEN us WHEN 1 THEN us - 19800000000 WHEN 2 THEN us + 82800000000 ELSE NULL END AS strict_us,
    CASE WHEN event_id % 6 = 0 THEN strftime(to_timestamp(us / 1e6) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ') END AS rendered FROM r""",
)
def timestamps_strict(spark, folder):
    base = events(spark, folder).select("event_id", times.utc_text(F.col("observed_at")).alias("t"))
    case = F.col("event_id") % 6
    body = F.expr("left(t, length(t) - 1)")
    raw = (
        F.when(case == 0, F.col("t"))
        .when(case == 1, F.concat(body, F.lit("+05:30")))
        .when(case == 2, F.concat(body, F.lit("-23:00")))
        .when(case == 3, body)
        .when(case == 4, F.concat(body, F.lit("1Z")))
        .otherwise(F.concat(body, F.lit("+24:00")))
    )
    parsed = base.select("event_id", raw.alias("raw")).select(
        "event_id", times.strict_instant(F.col("raw")).alias("at")
    )
    rendered = F.when(case == 0, times.utc_text(F.col("at")))
    return parsed.select("event_id", us("at").alias("strict_us"), rendered.alias("rendered"))


@query(
    "permalinks",
    """WITH r AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://x.com/acct/status/' || (page_id + 1) WHEN 1 THEN 'https://twitter.com/i/web/status/' || (page_id + 1) || '/' WHEN 2 THEN 'https://x.com.evil.com/acct/status/' || page_id
      WHEN 3 THEN 'https://x.com/other/status/' || (page_id + 1) WHEN 4 THEN 'https://x.com/acct/status/0' || page_id ELSE url END AS url FROM pages)
    SELECT page_id, CASE WHEN page_id % 6 IN (0, 1, 3) THEN CAST(page_id + 1 AS VARCHAR) END AS post_id, page_id % 6 = 0 AS owned, page_id % 6 IN (0, 3, 4) AS exact FROM r""",
)
def permalinks(spark, folder):
    i = F.col("page_id")
    url = (
        F.when(i % 6 == 0, F.concat(F.lit("https://x.com/acct/status/"), i + 1))
        .when(i % 6 == 1, F.concat(F.lit("https://twitter.com/i/web/status/"), i + 1, F.lit("/")))
        .when(i % 6 == 2, F.concat(F.lit("https://x.com.evil.com/acct/status/"), i))
        .when(i % 6 == 3, F.concat(F.lit("https://x.com/other/status/"), i + 1))
        .when(i % 6 == 4, F.concat(F.lit("https://x.com/acct/status/0"), i))
        .otherwise(F.col("url"))
    )
    return table(spark, folder, "pages").select(
        "page_id",
        links.post_id(url).alias("post_id"),
        links.belongs_to(url, F.lit("ACCT")).alias("owned"),
        links.is_exact_post(url).alias("exact"),
    )


@query(
    "native_identity",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey > 0 WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE o_orderkey > 0 END AS identity_ok FROM orders""",
)
def native_identity(spark, folder):
    k = F.col("o_orderkey")
    platform = F.when(k % 5 == 1, "twitter").when(k % 5 == 2, "forum").otherwise("x")
    native = F.when(k % 5 == 2, F.concat(F.lit("post-"), k)).when(k % 5 == 3, F.concat(F.lit("0"), k)).otherwise(k.cast("string"))
    url = F.when(k % 5 == 4, F.concat(F.lit("https://x.com/acct/status/"), k))
    return table(spark, folder, "orders").select(
        "o_orderkey", links.native_identity_ok(platform, native, url).alias("identity_ok")
    )


@query(
    "manifest_diff",
    """SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 9 = 0 THEN 'DELETED' WHEN doc_id % 4 = 0 THEN 'CHANGED' ELSE 'UNCHANGED' END AS status, sha256(text) AS sha256 FROM documents""",
)
def manifest_diff(spark, folder):
    docs = table(spark, folder, "documents")
    path = F.concat(F.lit("doc/"), "doc_id").alias("path")
    pinned = docs.select(path, F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    current = docs.filter(F.col("doc_id") % 9 != 0).select(path, F.sha2(changed, 256).alias("sha256"))
    return compare_manifests(pinned, current).select("path", "status", "sha256")

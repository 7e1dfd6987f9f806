"""Point-in-time admission, training-provenance checks and soft origin features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric
from ..functions.links import native_identity_ok
from .validation import Rule, failing_rule

CLASSES = ("human_written", "ai_generated", "mixed")
STATES = (*CLASSES, "unknown")
# Fixed values of the record contract.
FEATURE_KINDS = ("text", "media", "comments", "metadata")
STRATEGIES = ("chronological", "out_of_fold", "in_sample", "unknown")
EVIDENCE_METHODS = ("author_disclosure", "controlled_generation", "documented_creation")
LABEL_NAMES = (
    "label",
    "target",
    "truth_label",
    "ground_truth",
    "content_origin",
    "human_written_label",
    "ai_generated_label",
    "authorship_label",
)


def feature_rules() -> list[Rule]:
    """Rules of one input feature next to its prediction's version and generation time."""
    name, kind = F.col("name"), F.col("kind")
    captured, available, cutoff = F.col("captured_at"), F.col("available_at"), F.col("generated_at")
    event = F.col("latest_event_at")
    return [
        Rule("feature_name_missing", name.isNull() | (F.trim(name) == "")),
        Rule("feature_is_a_label", F.lower(name).isin(*LABEL_NAMES)),
        Rule("feature_kind", kind.isNull() | ~kind.isin(*FEATURE_KINDS)),
        Rule("feature_version", ~F.col("version").eqNullSafe(F.col("post_version"))),
        Rule("feature_clock_missing", captured.isNull() | available.isNull()),
        Rule("late_capture_or_availability", (captured > available) | (available > cutoff)),
        Rule("comments_need_latest_event", (kind == "comments") & event.isNull()),
        Rule("future_event", (event > captured) | (event > cutoff)),
    ]


def admit_features(features: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every feature with the first broken rule; rows without one are point-in-time safe.

    ``predictions`` has prediction_id, post_version and generated_at.
    """
    joined = features.join(
        predictions.select("prediction_id", "post_version", "generated_at"), "prediction_id"
    )
    return joined.withColumn("rule", failing_rule(feature_rules()))


def repeated_features(features: DataFrame) -> DataFrame:
    return (
        features.groupBy("prediction_id", "name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    )


def training_audit(predictions: DataFrame, training: DataFrame) -> DataFrame:
    """Leak checks of every prediction against its declared training posts.

    ``predictions``: prediction_id, platform, post_id, published_at, content_group_id, strategy,
    training_cutoff, trained_at, generated_at, prediction_at. ``training``: prediction_id,
    platform, post_id, published_at, latest_input_available_at, label_available_at,
    content_group_id. Training rows are reduced on the map side.
    """
    p = predictions.select(
        "prediction_id",
        "platform",
        "post_id",
        F.col("published_at").alias("target_published_at"),
        F.col("content_group_id").alias("target_group"),
        "strategy",
        "fold_id",
        "training_cutoff",
        "trained_at",
        "generated_at",
        "prediction_at",
    )
    t = training.select(
        "prediction_id",
        F.col("platform").alias("t_platform"),
        F.col("post_id").alias("t_post_id"),
        F.col("published_at").alias("t_published_at"),
        "latest_input_available_at",
        "label_available_at",
        F.col("content_group_id").alias("t_group"),
    )
    repeated = t.groupBy("prediction_id", "t_platform", "t_post_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = repeated.groupBy("prediction_id").agg(F.max("n").alias("_most"))
    same = (F.col("t_platform") == F.col("platform")) & (F.col("t_post_id") == F.col("post_id"))
    future = (F.col("t_published_at") > F.col("latest_input_available_at")) | (
        F.greatest("t_published_at", "latest_input_available_at", "label_available_at") > F.col("training_cutoff")
    )
    later = ~same & (F.col("t_published_at") >= F.col("target_published_at"))
    facts = t.join(p, "prediction_id").groupBy("prediction_id").agg(
        F.count(F.lit(1)).alias("training_group_count"),
        F.bool_or(same).alias("target_seen"),
        F.bool_or(F.coalesce(F.col("t_group") == F.col("target_group"), F.lit(False))).alias("group_seen"),
        F.bool_and(F.col("t_group").isNotNull()).alias("_all_groups"),
        F.bool_or(F.coalesce(future, F.lit(False))).alias("_future"),
        F.bool_or(F.coalesce(later, F.lit(False))).alias("_later"),
    )
    rows = p.join(facts, "prediction_id", "left").join(repeated, "prediction_id", "left")
    chronology = (
        (F.col("training_cutoff") <= F.col("trained_at"))
        & (F.col("trained_at") <= F.col("generated_at"))
        & (F.col("generated_at") <= F.col("prediction_at"))
    )
    rule = (
        F.when(~F.col("strategy").isin(*STRATEGIES), "unsupported_strategy")
        .when(~F.coalesce(chronology, F.lit(False)), "chronology")
        .when(
            (F.col("strategy") == "out_of_fold") & (F.coalesce(F.trim("fold_id"), F.lit("")) == ""), "fold_id_missing"
        )
        .when(F.col("training_group_count").isNull(), "training_groups_missing")
        .when(F.col("_most") > 1, "training_groups_repeated")
        .when(F.col("_future"), "future_training_material")
        .when(F.col("_later"), "later_or_same_time_training_post")
    )
    complete = F.col("target_group").isNotNull() & F.coalesce(F.col("_all_groups"), F.lit(False))
    passed = (
        rule.isNull()
        & F.col("strategy").isin("chronological", "out_of_fold")
        & ~F.col("target_seen")
        & ~F.col("group_seen")
    )
    return rows.select(
        "prediction_id",
        rule.alias("rule"),
        F.coalesce("training_group_count", F.lit(0)).alias("training_group_count"),
        (~F.col("target_seen")).alias("target_declared_post_id_excluded"),
        complete.alias("declared_content_groups_complete"),
        F.when(F.col("group_seen"), F.lit(False)).when(complete, F.lit(True)).alias(
            "target_declared_content_group_excluded"
        ),
        F.coalesce(passed, F.lit(False)).alias("auxiliary_eligible"),
        F.coalesce(passed & complete & F.col("target_published_at").isNotNull(), F.lit(False)).alias(
            "strict_cross_post_eligible"
        ),
    )


def shared_training_leaks(predictions: DataFrame, training_set: DataFrame) -> DataFrame:
    """Predictions whose post is in one shared training table."""
    return predictions.join(
        training_set.select("platform", "post_id").distinct(), ["platform", "post_id"], "left_semi"
    )


def prediction_rules() -> list[Rule]:
    """Rules of a flat prediction record."""
    cutoff = F.col("prediction_at")
    published, captured = F.col("published_at"), F.col("captured_at")
    generated, available = F.col("generated_at"), F.col("available_at")
    has_model = F.col("model_id").isNotNull()
    digest = F.col("weights_sha256")
    ps = [F.col(f"p_{c}") for c in CLASSES]
    return [
        Rule(
            "native_identity",
            ~native_identity_ok(F.col("platform"), F.col("post_id"), F.col("post_url")),
        ),
        Rule("version_missing", F.coalesce(F.trim("post_version"), F.lit("")) == ""),
        Rule("prediction_clock_missing", cutoff.isNull()),
        Rule("published_after_prediction", published > cutoff),
        Rule("captured_after_prediction", captured > cutoff),
        Rule("captured_before_publication", captured < published),
        Rule("prediction_clock_order", has_model & ~F.coalesce((generated <= available) & (available <= cutoff), F.lit(False))),
        Rule("weights_digest", digest.isNotNull() & ~digest.rlike(r"^[a-f0-9]{64}\z")),
        Rule("probabilities", has_model & ~numeric.simplex_ok(ps)),
    ]


def label_rules() -> list[Rule]:
    """Rules of a text-origin label with an evidence array."""
    evidence = F.col("evidence")
    known = F.col("content_origin") != "unknown"
    return [
        Rule("label_origin", F.col("content_origin").isNull() | ~F.col("content_origin").isin(*STATES)),
        Rule("label_scope", ~F.col("scope").eqNullSafe(F.lit("text.body"))),
        Rule("label_policy", F.coalesce(F.trim("label_policy"), F.lit("")) == ""),
        Rule("label_clock", F.col("label_available_at").isNull()),
        Rule("evidence_required", evidence.isNull() | (known & (F.size(evidence) == 0))),
        Rule(
            "evidence_method",
            ~F.forall(evidence, lambda e: F.coalesce(e["method"].isin(*EVIDENCE_METHODS), F.lit(False))),
        ),
        Rule(
            "evidence_reference",
            ~F.forall(evidence, lambda e: F.coalesce(F.trim(e["reference"]) != "", F.lit(False))),
        ),
        Rule(
            "evidence_after_label",
            F.exists(evidence, lambda e: F.coalesce(e["available_at"] > F.col("label_available_at"), F.lit(True))),
        ),
    ]


def estimates(predictions: DataFrame) -> DataFrame:
    """Estimated origin class and normalised entropy of every prediction."""
    ps = {c: F.col(f"p_{c}") for c in CLASSES}
    return predictions.withColumn("estimated_content_origin", numeric.arg_max_class(ps)).withColumn(
        "normalized_entropy", numeric.normalised_entropy(list(ps.values()))
    ).withColumn(
        "status",
        F.when(F.col(f"p_{CLASSES[0]}").isNull(), "unavailable").otherwise("unverified_external_model_estimate"),
    )


def soft_features(predictions: DataFrame, audits: DataFrame, strict: bool = False) -> DataFrame:
    """Probabilities, entropy and mask of eligible predictions available by the downstream time."""
    flag = "strict_cross_post_eligible" if strict else "auxiliary_eligible"
    eligible = audits.filter(F.col(flag)).select("prediction_id")
    downstream = F.coalesce(F.col("downstream_at"), F.col("prediction_at"))
    ps = {c: F.col(f"p_{c}") for c in CLASSES}
    usable = (F.col("prediction_at") <= downstream) & (
        F.col("available_at").isNull() | (F.col("available_at") <= downstream)
    )
    missing = ps[CLASSES[0]].isNull()
    return predictions.join(eligible, "prediction_id", "left_semi").filter(usable).select(
        "prediction_id",
        "prediction_at",
        downstream.alias("downstream_at"),
        *[p.alias(f"authorship_p_{c}") for c, p in ps.items()],
        numeric.normalised_entropy(list(ps.values())).alias("authorship_entropy"),
        missing.alias("authorship_missing"),
        (~missing).alias("authorship_is_model_estimate"),
    )


def evaluate_origin(predictions: DataFrame, labels: DataFrame, evaluation_at: Column) -> DataFrame:
    """Brier score and log loss where prediction and label were both available in time."""
    keys = ["platform", "post_id", "post_version"]
    rows = predictions.join(labels.select(*keys, "content_origin", "label_available_at"), keys).filter(
        (F.col("prediction_at") <= evaluation_at) & (F.col("label_available_at") <= evaluation_at)
    )
    ps = {c: F.col(f"p_{c}") for c in CLASSES}
    truth = F.col("content_origin")
    loss, reason = numeric.multiclass_log_loss(ps, truth)
    return rows.select(
        "prediction_id",
        *keys,
        truth.alias("content_origin"),
        F.when(ps[CLASSES[0]].isNull(), "unavailable_prediction")
        .when(truth == "unknown", "unknown_label")
        .otherwise("descriptive_evaluation")
        .alias("status"),
        numeric.multiclass_brier(ps, truth).alias("brier"),
        loss.alias("log_loss"),
        reason.alias("log_loss_reason"),
    )

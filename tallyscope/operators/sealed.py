"""Forecasts sealed before their target: contract checks, capture choice and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import is_finite
from ..functions.times import seconds_between
from .exposure import add_errors
from .ordered import HOT_ROWS, with_previous
from .validation import Rule, split

IDENTITY = ["forecast_id", "post_url", "version", "source", "metric"]
# Surface to the counter it is measured by, and the largest late budget.
METRICS = {"public_views": "views", "owner_impressions": "impressions"}
LATE_BUDGET_SECONDS = 300


def forecast_rules() -> list[Rule]:
    """Row rules of a sealed forecast with flat clock columns."""
    def c(name: str):
        return F.col(name)

    clocks = ["published_at", "origin_at", "input_cutoff_at", "generated_at", "frozen_at", "target_at"]
    missing = F.lit(False)
    for name in [*IDENTITY, *clocks, "status", "post_id", "accepted_from", "accepted_to"]:
        missing = missing | c(name).isNull()
    pairs = F.lit(False)
    for source, metric in METRICS.items():
        pairs = pairs | ((c("source") == source) & (c("metric") == metric))
    budget = c("late_tolerance_seconds")
    return [
        Rule("missing_identity_or_clock", missing),
        Rule("not_frozen_before_target", c("status") != "frozen_before_target"),
        Rule("source_metric_mismatch", ~pairs),
        Rule("post_id_url_mismatch", ~c("post_url").endswith(F.concat(F.lit("/status/"), c("post_id")))),
        Rule(
            "clock_order",
            ~(
                (c("published_at") <= c("origin_at"))
                & (c("origin_at") <= c("input_cutoff_at"))
                & (c("input_cutoff_at") <= c("generated_at"))
                & (c("generated_at") <= c("frozen_at"))
                & (c("frozen_at") < c("target_at"))
            ),
        ),
        Rule("late_budget", budget.isNull() | ~budget.between(0, LATE_BUDGET_SECONDS)),
        Rule("early_tolerance", ~c("early_tolerance_seconds").eqNullSafe(F.lit(0))),
        Rule(
            "window_mismatch",
            (c("accepted_from") != c("target_at"))
            | (seconds_between(c("accepted_from"), c("accepted_to")) != budget),
        ),
    ]


def input_audit(forecasts: DataFrame, inputs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per forecast: first broken input rule, latest input and its count.

    ``inputs`` has forecast_id, index, source, observed_at, started_at, completed_at, available_at
    and value.
    """
    clocks = forecasts.select(
        "forecast_id",
        F.col("source").alias("_source"),
        F.col("published_at").alias("_published"),
        F.col("input_cutoff_at").alias("_cutoff"),
        F.col("origin_at").alias("_origin"),
        F.col("n_numeric_points").alias("_declared"),
    )
    rows = with_previous(inputs, ["forecast_id"], "index", ["observed_at"], (), hot_rows)
    rows = rows.join(clocks, "forecast_id")
    start = F.coalesce(F.col("started_at"), F.col("observed_at"))
    end = F.coalesce(F.col("completed_at"), F.col("observed_at"))
    available = F.coalesce(F.col("available_at"), F.col("observed_at"))
    per = rows.groupBy("forecast_id", "_origin", "_declared").agg(
        F.count(F.lit(1)).alias("n_inputs"),
        F.max("observed_at").alias("latest_input_at"),
        F.max_by("value", "index").alias("origin_count"),
        F.bool_or(F.coalesce(F.col("source") != F.col("_source"), F.lit(False))).alias("_foreign"),
        F.bool_or(F.col("value").isNull() | (F.col("value") < 0)).alias("_uncounted"),
        F.bool_or(F.coalesce(F.col("observed_at") <= F.col("prev.observed_at"), F.lit(False))).alias("_unordered"),
        F.bool_or((start > end) | (F.col("observed_at") != end)).alias("_capture"),
        F.bool_or((start < F.col("_published")) | (available < end) | (available > F.col("_cutoff"))).alias("_late"),
    )
    return per.select(
        "forecast_id",
        "n_inputs",
        "latest_input_at",
        "origin_count",
        F.when(F.col("_foreign"), "input_source_mismatch")
        .when(F.col("_capture"), "input_capture_invalid")
        .when(F.col("_late"), "input_not_available_by_cutoff")
        .when(F.col("_uncounted") | F.col("_unordered"), "inputs_not_chronological")
        .when(F.col("latest_input_at") != F.col("_origin"), "origin_is_not_latest_input")
        .when(F.col("n_inputs") != F.col("_declared"), "input_count_mismatch")
        .alias("input_rule"),
    )


def actual_rules() -> list[Rule]:
    """Rules of one actual capture joined to its forecast's publication clock."""
    start, end = F.col("observation_started_at"), F.col("observation_completed_at")
    return [
        Rule("capture_clock_missing", start.isNull() | end.isNull() | F.col("observed_at").isNull()),
        Rule("capture_reversed", start > end),
        Rule("observed_at_is_not_capture_end", F.col("observed_at") != end),
        Rule("capture_before_publication", start < F.col("published_at")),
        Rule("available_before_capture_end", F.col("available_at") < end),
        Rule("actual_not_a_count", F.col("actual") < 0),
    ]


def choose_captures(forecasts: DataFrame, actuals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first eligible capture per forecast, rejected captures).

    The choice is the first numeric read that ended at or after the target, otherwise the first
    numeric read; both are minima, so no history is sorted or gathered.
    """
    clocks = forecasts.select(*IDENTITY, "published_at", "target_at")
    joined = actuals.join(clocks, IDENTITY)
    ok, bad = split(joined, actual_rules())
    read = F.struct(
        F.col("observation_completed_at").alias("completed_at"),
        F.col("observation_started_at").alias("started_at"),
        "actual",
        "available_at",
    )
    same_end = ok.groupBy(*IDENTITY, "observation_completed_at").agg(
        F.min(read).alias("read"),
        F.max(read).alias("_other"),
        # A missing count next to a numeric one is a conflict as well.
        F.count_if(F.col("actual").isNull()).alias("_nulls"),
        F.count(F.lit(1)).alias("_n"),
        F.first("target_at").alias("target_at"),
    )
    conflicting = ~F.col("read").eqNullSafe(F.col("_other"))
    conflicts = same_end.filter(conflicting).select(
        *IDENTITY, F.lit("conflicting_capture").alias("rule"), F.col("observation_completed_at")
    )
    rejected = bad.select(*IDENTITY, "rule", "observation_completed_at").unionByName(conflicts)
    numeric = same_end.filter(~conflicting & F.col("read.actual").isNotNull())
    at_target = F.col("observation_completed_at") >= F.col("target_at")
    chosen = numeric.groupBy(*IDENTITY).agg(
        F.min(F.when(at_target, F.col("read"))).alias("_after"), F.min("read").alias("_any")
    )
    return chosen.select(*IDENTITY, F.coalesce("_after", "_any").alias("selected")), rejected


def evaluate(forecasts: DataFrame, audits: DataFrame, chosen: DataFrame) -> DataFrame:
    """Status, lateness, eligibility and revision flag of every forecast."""
    rows = forecasts.join(chosen, IDENTITY, "left").join(
        audits.select("forecast_id", "origin_count"), "forecast_id", "left"
    )
    end, start = F.col("selected.completed_at"), F.col("selected.started_at")
    target = F.col("target_at")
    status = (
        F.when(F.col("selected").isNull(), "pending")
        .when(end < target, "early")
        .when(start < target, "early_or_straddling_capture")
        .when(end > F.col("accepted_to"), "outside_window")
        .when(end == target, "exact_target_observation")
        .otherwise("delayed_proxy")
    )
    in_window = F.col("evaluation_status").isin("exact_target_observation", "delayed_proxy")
    revised = F.col("selected.actual") < F.col("origin_count")
    return (
        rows.withColumn("evaluation_status", status)
        .withColumn("target_window_eligible", in_window)
        .withColumn("apparent_revision", revised)
        .select(
            *IDENTITY,
            "target_at",
            "evaluation_status",
            F.col("selected.actual").alias("actual"),
            end.alias("selected_at"),
            seconds_between(F.col("published_at"), end).alias("actual_age_seconds"),
            seconds_between(target, end).alias("lateness_seconds"),
            F.when(F.col("evaluation_status") == "exact_target_observation", F.col("selected.actual")).alias(
                "exact_target_actual"
            ),
            "target_window_eligible",
            (F.col("target_window_eligible") & ~F.coalesce(F.col("apparent_revision"), F.lit(False))).alias(
                "eligible_primary_comparison"
            ),
            "apparent_revision",
        )
    )


def undeclared(evaluations: DataFrame, declarations: DataFrame) -> DataFrame:
    """Scored forecasts that lack a first-read or complete-history declaration."""
    declared = declarations.filter(
        F.coalesce(F.col("first_read_declared"), F.lit(False))
        | F.coalesce(F.col("history_complete_declared"), F.lit(False))
    )
    return evaluations.filter("target_window_eligible").join(declared, "forecast_id", "left_anti")


def score_models(evaluations: DataFrame, predictions: DataFrame) -> DataFrame:
    """Errors of every model's point prediction against the selected capture."""
    p = F.col("point_prediction")
    usable = predictions.filter(p.isNull() | (is_finite(p) & (p >= 0)))
    rows = usable.join(evaluations, "forecast_id")
    return add_errors(rows, "actual", "point_prediction")

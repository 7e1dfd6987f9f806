"""Counts, safe ratios, bounds and errors as column expressions.

Missing stays null, a zero denominator gives null, and each null can be given a reason.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest integer a double holds exactly.
MAX_EXACT = 9007199254740991
# Two-sided 95 % normal quantile used by the score interval.
Z95 = 1.959963984540054
POPULAR_HALF_LIFE_HOURS = 8.0
POPULAR_WINDOW_HOURS = 24.0
POPULAR_AGE_FLOOR_HOURS = 0.5


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def count_from_text(raw: Column) -> Column:
    """ASCII digits only, at most 2^53 - 1; anything else is null."""
    number = F.when(raw.rlike(r"^[0-9]+\z"), raw.try_cast("bigint"))
    return F.when(number <= MAX_EXACT, number)


def count_is_bad(raw: Column) -> Column:
    """A present value that is not an exact non-negative integer."""
    return raw.isNotNull() & count_from_text(raw).isNull()


def number_from_text(raw: Column) -> Column:
    """A finite decimal number; NaN, infinities and boolean words are null."""
    number = F.when(raw.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"), raw.try_cast("double"))
    return F.when(is_finite(number), number)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio with a strictly positive denominator and a finite result, else null."""
    ratio = numerator.cast("double") / F.when(denominator > 0, denominator.cast("double"))
    return F.when(is_finite(ratio), ratio)


def ratio_reason(exposure: Column, counter: Column) -> Column:
    return (
        F.when(exposure.isNull(), "unknown_impressions")
        .when(exposure == 0, "zero_impressions")
        .when(counter.isNull(), "unknown_counter")
    )


def event_ratio(counter: Column, exposure: Column) -> Column:
    """Counted events per impression; may exceed one."""
    return F.when(ratio_reason(exposure, counter).isNull(), safe_ratio(counter, exposure))


def per_thousand(ratio: Column) -> Column:
    return ratio * 1000


def stock_ratio(numerator: Column, denominator: Column) -> Column:
    """Same-capture ratio such as following per follower."""
    return safe_ratio(numerator, denominator)


def stock_ratio_reason(numerator: Column, denominator: Column) -> Column:
    return F.when(
        numerator.isNull() | denominator.isNull(), "missing_same_snapshot_counts"
    ).when(denominator == 0, "zero_denominator")


def cohort_status(n: Column, unknown: Column) -> Column:
    return (
        F.when(n.isNull(), "unavailable")
        .when(n == 0, "undefined")
        .when(unknown > 0, "classification_incomplete")
        .otherwise("classified")
    )


def lower_bound(high: Column, n: Column) -> Column:
    return safe_ratio(high, n)


def upper_bound(high: Column, unknown: Column, n: Column) -> Column:
    return safe_ratio(high + unknown, n)


def coverage_label(complete: Column, scope: Column, captured: Column, total: Column) -> Column:
    """Captured over total for an incomplete list of all followers, otherwise null."""
    def show(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("unknown"))

    return F.when(
        (complete == F.lit(False)) & (scope == "all_followers"),
        F.concat(show(captured), F.lit("/"), show(total)),
    )


def wilson(high: Column, n: Column) -> tuple[Column, Column]:
    """Score interval at 95 %, clamped to [0, 1]; null when there is no trial."""
    trials = F.when(n > 0, n.cast("double"))
    p = high.cast("double") / trials
    scale = F.lit(1.0) + F.lit(Z95 * Z95) / trials
    center = (p + F.lit(Z95 * Z95) / (trials * 2)) / scale
    spread = F.sqrt(p * (F.lit(1.0) - p) / trials + F.lit(Z95 * Z95) / (trials * trials * 4))
    radius = F.lit(Z95) * spread / scale
    low = F.when(trials.isNotNull(), F.greatest(F.lit(0.0), center - radius))
    top = F.when(trials.isNotNull(), F.least(F.lit(1.0), center + radius))
    return low, top


def popular_score(views: Column, age_seconds: Column) -> Column:
    """Age-normalised popularity on an eight-hour curve; null past the 24-hour window."""
    rate = math.log(2) / POPULAR_HALF_LIFE_HOURS
    full = -math.expm1(-rate * POPULAR_WINDOW_HOURS)
    age_hours = F.greatest(age_seconds / 3600, F.lit(POPULAR_AGE_FLOOR_HOURS))
    return F.when(
        (age_seconds >= 0) & (age_seconds <= POPULAR_WINDOW_HOURS * 3600),
        views * F.lit(full) / -F.expm1(age_hours * F.lit(-rate)),
    )


def popular_status(age_seconds: Column) -> Column:
    return F.when(age_seconds <= POPULAR_WINDOW_HOURS * 3600, "candidate_pool_score").otherwise(
        "outside_official_selection_window"
    )


# Upper edges in seconds of the comparison bins and their names, in order.
HORIZONS = (
    (900, "0_to_15_minutes"),
    (3600, "15_to_60_minutes"),
    (21600, "1_to_6_hours"),
    (86400, "6_to_24_hours"),
)
HORIZON_BEYOND = "over_24_hours"


def horizon_bucket(seconds: Column) -> Column:
    expression = F
    for edge, name in HORIZONS:
        expression = expression.when(seconds <= edge, name)
    return F.when(seconds.isNotNull(), expression.otherwise(HORIZON_BEYOND))


def horizon_order(bucket: Column) -> Column:
    expression = F
    for position, (_, name) in enumerate(HORIZONS):
        expression = expression.when(bucket == name, position)
    return expression.otherwise(len(HORIZONS))


def signed_error(actual: Column, prediction: Column) -> Column:
    return prediction - actual


def symmetric_percent(actual: Column, prediction: Column) -> Column:
    """200 |p - y| / (|p| + |y|), where zero against zero is exactly zero."""
    total = F.abs(prediction) + F.abs(actual)
    return F.when(total == 0, F.lit(0.0)).otherwise(
        F.abs(prediction - actual) * 200 / F.when(total != 0, total)
    )


def recent_rate_prediction(
    previous_value: Column, value: Column, span: Column, horizon: Column
) -> Column:
    """Straight line through the last two points; null after a counter fell or without time."""
    usable = (span > 0) & (horizon > 0) & (value >= previous_value)
    return F.when(usable, value + (value - previous_value) / F.when(span > 0, span) * horizon)


def saturation_value(base: Column, amplitude: Column, tau: Column, age: Column) -> Column:
    return base + amplitude * -F.expm1(-age / tau)


def saturation_prediction(
    base: Column, amplitude: Column, tau: Column, origin_value: Column, origin_age: Column, target_age: Column
) -> Column:
    """Keep the actual counter at the origin and add the increment of the curve."""
    increment = saturation_value(base, amplitude, tau, target_age) - saturation_value(
        base, amplitude, tau, origin_age
    )
    return F.when((target_age > origin_age) & (increment >= 0), origin_value + increment)


def early_rate_prediction(observed: Column, cutoff: Column, horizon: int = 86400) -> Column:
    return observed * (F.lit(horizon) - cutoff) / cutoff


def count_bucket(n: Column) -> Column:
    """floor(log2(n + 1)) through the length of the binary text, exact for every count."""
    return F.length(F.bin(n + 1)) - 1


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, F.lit(1.0) / (F.exp(-x) + 1)).otherwise(F.exp(x) / (F.exp(x) + 1))


def stable_nll(logit: Column, label: Column, temperature: Column | float = 1.0) -> Column:
    """Binary negative log likelihood of one row from its logit."""
    scaled = logit / temperature
    return F.greatest(scaled, F.lit(0.0)) - label * scaled + F.log1p(F.exp(-F.abs(scaled)))


def simplex_ok(probabilities: list[Column]) -> Column:
    """Every part finite in [0, 1] and a sum of one within 1e-8; nothing is renormalised."""
    inside = F.lit(True)
    total = F.lit(0.0)
    for p in probabilities:
        inside = inside & is_finite(p) & p.between(0.0, 1.0)
        total = total + p
    return F.coalesce(inside & (F.abs(total - 1) <= 1e-8), F.lit(False))


def normalised_entropy(probabilities: list[Column]) -> Column:
    total = F.lit(0.0)
    for p in probabilities:
        total = total - F.when(p > 0, p * F.log(p)).otherwise(F.lit(0.0))
    return F.when(probabilities[0].isNotNull(), total / math.log(len(probabilities)))


def arg_max_class(probabilities: dict[str, Column]) -> Column:
    """Name of the single largest probability; ties and missing models are unknown."""
    best = F.greatest(*probabilities.values())
    winners = F.lit(0)
    name = F
    for label, p in probabilities.items():
        winners = winners + (p == best).cast("int")
        name = name.when(p == best, label)
    return F.when(best.isNotNull() & (winners == 1), name).otherwise("unknown")


def multiclass_brier(probabilities: dict[str, Column], truth: Column) -> Column:
    total = F.lit(0.0)
    for label, p in probabilities.items():
        hit = (truth == label).cast("double")
        total = total + (p - hit) * (p - hit)
    return F.when(truth.isin(*probabilities), total)


def multiclass_log_loss(probabilities: dict[str, Column], truth: Column) -> tuple[Column, Column]:
    """Loss and the reason it is missing when the true class was given zero probability."""
    chosen = F
    for label, p in probabilities.items():
        chosen = chosen.when(truth == label, p)
    loss = F.when(chosen > 0, -F.log(chosen))
    reason = F.when(chosen == 0, "infinite_for_zero_target_probability")
    return loss, reason


def pinball(actual: Column, prediction: Column, quantile: float) -> Column:
    residual = actual - prediction
    return F.greatest(residual * quantile, residual * (quantile - 1))


def quantiles_ordered(low: Column, middle: Column, high: Column) -> Column:
    return F.coalesce((low >= 0) & (low <= middle) & (middle <= high), F.lit(False))

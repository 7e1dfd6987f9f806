"""Public entry points: each composes the operators into the tables of one report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import cohort_status, lower_bound, stock_ratio, stock_ratio_reason, upper_bound
from ..functions.text import decision_gate, hashed_features, normalise, text_groups
from ..functions import numeric
from ..operators import answers, cascades, exposure, intervals, leakage, metrics, posts, progress, sealed, snapshots, validation
from ..operators.ordered import HOT_ROWS
from ..operators.splits import label_blind, only, same_members
from ..session import cut_lineage
from . import fitting, minibatch

Tables = dict[str, DataFrame]


def compare_snapshots(snaps: DataFrame, members: DataFrame, post_rows: DataFrame | None = None, pairs: DataFrame | None = None) -> Tables:
    """Growth, member changes, warnings and post feedback of every snapshot pair."""
    # Pairs are used by every part below; they are headers, so they are written once.
    pairs = cut_lineage(snapshots.consecutive_pairs(snaps) if pairs is None else pairs)
    refused = snapshots.incomparable(pairs)
    ids = ["account", "before_snapshot_id", "after_snapshot_id"]
    usable = pairs.join(refused.select(*ids), ids, "left_anti")
    changes = snapshots.member_changes(usable, members)
    summary = snapshots.arrival_summary(usable, changes)
    # Id and handle matching must not be mixed: it would invent arrivals.
    growth = summary.filter(~F.col("mixed_identity_modes"))
    mixed = summary.filter("mixed_identity_modes").select(*ids, F.lit("mixed_identity_modes").alias("reason"))
    out = {
        "growth": growth,
        "changes": changes,
        "warnings": snapshots.warning_rows(growth),
        "refused": refused.select(*ids, "reason").unionByName(mixed),
    }
    if post_rows is not None:
        out["post_feedback"] = snapshots.post_feedback(usable, post_rows)
    return out


def diagnose_rates(
    followers: DataFrame, post_clocks: DataFrame | None = None, tolerance: float = 0.2, value: str = "total", hot_rows: int = HOT_ROWS
) -> Tables:
    """Comparison of the last two profile intervals per account, with captures inside each."""
    if not 0 <= tolerance <= 1:
        raise ValueError("window tolerance must be a fraction between 0 and 1")
    keys = ["account"]
    rates = intervals.last_two_rates(followers, keys, value, tolerance, hot_rows=hot_rows)
    out = {
        "comparison": rates,
        "skipped": intervals.skip_summary(followers, keys, value),
        "disorder": validation.out_of_order(followers, keys, "index", hot_rows=hot_rows),
    }
    if post_clocks is not None:
        sides = rates.select(
            "account",
            F.explode(
                F.array(
                    F.struct(F.col("previous_started_at").alias("started_at"), F.col("previous_ended_at").alias("ended_at")),
                    F.struct(F.col("latest_started_at").alias("started_at"), F.col("latest_ended_at").alias("ended_at")),
                )
            ).alias("s"),
        ).select("account", "s.*").filter(F.col("started_at").isNotNull())
        out["captures_in_window"] = intervals.containment_counts(
            sides, post_clocks, keys, "started_at", "ended_at", "observed_at"
        )
    return out


def count_dynamics(observations: DataFrame, value: str, keys: Sequence[str] = ("account",), hot_rows: int = HOT_ROWS) -> Tables:
    """Intervals, accelerations, weighted average and skipped rows of a stock series."""
    rates = intervals.intervals(observations, keys, value, hot_rows=hot_rows)
    return {
        "intervals": rates,
        "accelerations": intervals.accelerations(rates, keys, hot_rows),
        "weighted_average": intervals.weighted_rate(observations, keys, value),
        "skipped": intervals.split_usable(observations, value)[1],
        "disorder": validation.out_of_order(observations, keys, "index", hot_rows=hot_rows),
    }


def following_ratios(followers: DataFrame) -> DataFrame:
    return followers.withColumn(
        "following_to_total_ratio", stock_ratio(F.col("following"), F.col("total"))
    ).withColumn("reason", stock_ratio_reason(F.col("following"), F.col("total")))


def cohort_quality(cohorts: DataFrame) -> DataFrame:
    n, high, unknown = F.col("observed_arrivals"), F.col("high"), F.col("unknown")
    return (
        cohorts.withColumn("status", cohort_status(n, unknown))
        .withColumn("lower_bound", lower_bound(high, n))
        .withColumn("upper_bound", upper_bound(high, unknown, n))
    )


def post_views(observations: DataFrame, hot_rows: int = HOT_ROWS) -> Tables:
    """Per-post view intervals; repeats of one capture collapse, conflicting ones are listed."""
    counters = ["views", "replies", "likes", "reposts", "bookmarks"]
    timed = observations.filter(F.col("observed_at").isNotNull())
    named = timed.withColumn("status_id", posts.post_id(F.col("url")))
    keyed = named.filter(F.col("status_id").isNotNull())
    single, conflicts = validation.dedupe_captures(keyed.select("status_id", "observed_at", *counters), ["status_id"], counters)
    return {
        "intervals": intervals.counter_intervals(single, ["status_id"], "views", hot_rows=hot_rows),
        "conflicts": conflicts,
        "rejected": named.filter(F.col("status_id").isNull()).drop("status_id"),
        "skipped": intervals.split_usable(observations, "views")[1],
    }


def growth_report(tables: Tables) -> Tables:
    """Follower and blue dynamics, following ratios, cohort quality and post views of documents."""
    followers, blues = tables["follower_observations"], tables["blue_observations"]
    views = post_views(tables["post_observations"])
    return {
        **{f"follower_{k}": v for k, v in count_dynamics(followers, "total").items()},
        **{f"blue_{k}": v for k, v in count_dynamics(blues, "count").items()},
        "following_ratios": following_ratios(followers),
        "cohort_quality": cohort_quality(tables["blue_cohort"]),
        **{f"post_view_{k}": v for k, v in views.items()},
    }


def post_statistics(catalog: DataFrame, analytics: DataFrame, public: DataFrame, hot_rows: int = HOT_ROWS) -> Tables:
    """Captures, latest capture and paired intervals per post and surface, on separate clocks."""
    clocks = posts.age_clocks(catalog)
    out: Tables = {"clocks": clocks}
    for surface, rows in (("owner_analytics", analytics), ("public_surface", public)):
        captured = posts.captures(rows, clocks, surface)
        out[f"{surface}_captures"] = captured
        out[f"{surface}_conflicts"] = posts.capture_conflicts(rows, surface)
        out[f"{surface}_latest"] = posts.per_post_latest(captured)
        out[f"{surface}_intervals"] = posts.surface_intervals(captured, surface, hot_rows)
    return out


def exposure_backtest(
    collections: Tables,
    curve: bool = False,
    forecast_hours: float = 24.0,
    fit_fn: Callable | None = None,
    epochs: int = fitting.CURVE_EPOCHS,
    hot_rows: int = HOT_ROWS,
) -> Tables:
    """Rolling-origin predictions, error summaries, matched comparison and future forecasts."""
    if not forecast_hours > 0:
        raise ValueError("forecast_hours must be positive")
    stacked = exposure.stack_collections(collections)
    hot = exposure.hot_series(stacked, hot_rows)
    points, skipped, rejected = exposure.load_series(stacked)
    rows = exposure.unrevised(points, hot=hot)
    predictions = exposure.rolling_predictions(rows)
    out = {
        "series": exposure.series_status(points, hot=hot),
        "skipped": skipped,
        "rejected": rejected,
        "popular": exposure.popular_scores(points),
        "forecasts": exposure.extrapolate(rows, forecast_hours),
    }
    if curve:
        fits = fitting.saturation_fits(rows, epochs, fit_fn=fit_fn)
        predictions = predictions.unionByName(fitting.curve_predictions(rows, fits))
        ends = rows.filter("is_last").select(*exposure.SERIES, "position")
        out["final_fits"] = fits.join(ends, [*exposure.SERIES, "position"], "left_semi")
        matched = exposure.matched_origins(predictions, fitting.CURVE_MODEL)
        out["matched_summary"] = exposure.error_summary(matched)
        out["matched_guard"] = validation.equal_sample_guard(out["matched_summary"])
    out["predictions"] = predictions
    out["summary"] = exposure.error_summary(predictions)
    return out


def evaluate_forecasts(forecasts: DataFrame, inputs: DataFrame, predictions: DataFrame, captures: DataFrame, declarations: DataFrame) -> Tables:
    """Status, eligibility and errors of sealed forecasts; broken contracts are listed apart."""
    ok, bad = validation.split(forecasts, sealed.forecast_rules())
    audits = sealed.input_audit(ok, inputs)
    sound = ok.join(audits.filter(F.col("input_rule").isNull()).select("forecast_id"), "forecast_id", "left_semi")
    chosen, refused = sealed.choose_captures(sound, captures)
    # A conflicting or invalid capture invalidates its forecast until it is reconciled.
    sound = sound.join(refused.select("forecast_id").distinct(), "forecast_id", "left_anti")
    evaluations = sealed.evaluate(sound, audits, chosen)
    undeclared = sealed.undeclared(evaluations, declarations)
    final = evaluations.join(undeclared.select("forecast_id"), "forecast_id", "left_anti")
    return {
        "evaluations": final,
        "models": sealed.score_models(final, predictions),
        "rejected_forecasts": bad,
        "rejected_inputs": audits.filter(F.col("input_rule").isNotNull()),
        "rejected_captures": refused,
        "undeclared": undeclared,
    }


def rolling_progress(observations: DataFrame, targets: DataFrame, keys: Sequence[str], source: str, hot_rows: int = HOT_ROWS) -> Tables:
    """Latest progress towards the targets and the net changes between captures."""
    with_goals = progress.with_targets(observations, targets)
    ok, bad = validation.split(with_goals, validation.rolling_rules(source))
    ok = ok.select(*observations.columns)
    return {
        "latest": progress.progress_latest(ok, keys, targets),
        "intervals": progress.progress_intervals(ok, keys, hot_rows),
        "rejected": bad,
    }


def prepare_cascades(index: DataFrame, events: DataFrame, probes: int | None = None, hot_rows: int = HOT_ROWS) -> Tables:
    """Features, quarantine, coverage, audits and label recount of an event corpus."""
    flags = cascades.id_flags(index)
    assigned = cascades.assign_events(index, events)
    rows = cascades.features(cascades.usable_segments(flags), cascades.cascade_counts(assigned))
    return {
        "features": rows,
        "quarantine": cascades.quarantined_ids(flags),
        "coverage": cascades.coverage(index),
        "cascades_by_day": cascades.cascades_by_day(index),
        "groups": cascades.group_totals(rows),
        "anomalies": cascades.source_anomalies(assigned, hot_rows),
        "broken_ranges": cascades.broken_ranges(index),
        "bad_origins": cascades.bad_origins(assigned),
        "recount": cascades.label_recount(rows, assigned, probes),
    }


def verify_features(rows: DataFrame, usable: DataFrame) -> Tables:
    """Row, pair and coverage checks of a feature table against its usable segments."""
    ok, bad = validation.split(rows, validation.feature_row_rules())
    pairs = validation.paired_cutoffs(ok)
    ids = usable.select(F.format_string("cascade-%06d", F.col("sequence")).alias("cascade_id"))
    return {
        "bad_rows": bad,
        "bad_pairs": pairs.filter(F.col("rule").isNotNull()),
        "coverage": same_members(pairs, ids, ["cascade_id"]),
    }


NETWORK = "tiny_mlp_log1p"


def cascade_benchmark(rows: DataFrame, epochs: int = 15, batch: int = minibatch.BATCH) -> Tables:
    """Baselines and the small network fitted on training rows, scored once on evaluation rows."""
    split = F.col("strict_label_available_split")
    train, test = rows.filter(split == "train_candidate"), rows.filter(split == "evaluation_candidate")
    overall, buckets = metrics.fit_baselines(only(train, split == "train_candidate", "baselines fit on training rows only"))
    parts = []
    parity = None
    wanted = [minibatch.Candidate(cutoff, "count", fitting.SEED + cutoff, refit=True) for cutoff in cascades.CUTOFFS]
    models = minibatch.fit_candidates(rows, wanted, epochs, batch)
    for cutoff, model in zip(cascades.CUTOFFS, models, strict=True):
        wide = metrics.baseline_predictions(test.filter(F.col("cutoff_seconds") == cutoff), overall, buckets)
        parts.append(wide.withColumn(NETWORK, model.score_sql(cascades.feature_vector())[0]))
        check = fitting.score_parity(fitting.training_rows(rows, cutoff), model).withColumn(
            "cutoff_seconds", F.lit(cutoff)
        )
        parity = check if parity is None else parity.unionByName(check)
    # Written once: every use of a score would evaluate the whole network again.
    wide = cut_lineage(parts[0].unionByName(parts[1]))
    predictions = metrics.prediction_rows(wide, (*metrics.BASELINES, NETWORK))
    strata = metrics.strata(predictions, "observed_retweet_count", "actual", with_zero=False)
    table = metrics.count_metrics(strata, ["cutoff_seconds", "model", "stratum"])
    return {
        "predictions": predictions,
        "metrics": table,
        "audit": cascades.partition_audit(rows),
        "comparison": metrics.matched_comparison(
            table, "train_log_count_bucket_median", NETWORK, ["cutoff_seconds", "stratum"]
        ),
        "parity": parity,
    }


CANDIDATES = ("original_smooth_l1", "ordered_quantile_pinball")


def cascade_quantiles(raw_rows: DataFrame, epochs: int = 15, batch: int = minibatch.BATCH) -> Tables:
    """Point and quantile candidates fitted inside the training days and compared on validation."""
    parsed, skipped = label_blind(raw_rows, ("future_retweets_to_24h", "total_retweets_at_24h"))
    parts = []
    wanted = [
        minibatch.Candidate(cutoff, kind, fitting.SEED + cutoff) for cutoff in cascades.CUTOFFS for kind in ("count", "quantile")
    ]
    models = iter(minibatch.fit_candidates(parsed, wanted, epochs, batch))
    for cutoff in cascades.CUTOFFS:
        held = fitting.training_rows(parsed, cutoff).filter(F.col("part") == "validation")
        for name, kind in zip(CANDIDATES, ("count", "quantile")):
            model = next(models)
            parts.append(
                held.select(
                    "cascade_id",
                    F.lit(cutoff).alias("cutoff_seconds"),
                    "observed_retweet_count",
                    F.col("target").alias("actual"),
                    F.lit(name).alias("model"),
                    F.lit(model.selected_epoch).alias("selected_epoch"),
                    model.score_sql(F.col("x")).alias("_p"),
                )
            )
    predictions = parts[0]
    for part in parts[1:]:
        predictions = predictions.unionByName(part)
    # Written once: every use of a score would evaluate the whole network again.
    wide = F.size("_p") == 3
    predictions = cut_lineage(predictions).select(
        *[c for c in predictions.columns if c != "_p"],
        F.when(wide, F.get("_p", F.lit(0))).alias("lower"),
        F.get("_p", F.when(wide, 1).otherwise(0)).alias("median"),
        F.get("_p", F.lit(2)).alias("upper"),
    )
    keys = ["cutoff_seconds", "model", "selected_epoch", "stratum"]
    strata = metrics.strata(predictions, "observed_retweet_count", "actual")
    errors = metrics.count_metrics(strata, keys, prediction="median")
    spans = metrics.interval_metrics(strata, keys).drop("n")
    table = errors.join(spans, keys)
    best = metrics.choose_candidate(
        table.filter(F.col("stratum") == "all"), ["cutoff_seconds"], "mae", CANDIDATES, "selected_epoch"
    )
    disorder = predictions.filter(
        F.col("lower").isNotNull() & ~numeric.quantiles_ordered(F.col("lower"), F.col("median"), F.col("upper"))
    )
    return {"predictions": predictions, "metrics": table, "selected": best, "skipped": skipped, "disorder": disorder}


def origin_dataset(qa: DataFrame, seed: int, with_text: bool = True) -> Tables:
    """Grouped, de-duplicated and split answers with their coverage.

    Occurrences and retained answers are read several times, so each is written once; without their texts, which most
    of the tables don't need, they are small. Texts are dealt out once, to join the rows they belong to.
    """
    written = answers.occurrences(qa)
    written = cut_lineage(written if with_text else written.drop("text"))
    rows = written.drop("text")
    groups = cut_lineage(answers.question_groups(rows))
    split_rows = answers.split_answers(cut_lineage(answers.retained_answers(rows, groups)), seed)
    return {
        "rows": split_rows.join(answers.answer_texts(written), "answer_sha256") if with_text else split_rows,
        "groups": groups,
        "answer_status": answers.answer_status(rows),
        "occurrences": answers.occurrence_counts(rows),
        "summary": answers.split_summary(split_rows),
        "coverage": answers.occurrence_coverage(rows, split_rows),
    }


def subgroup_metrics(scored: DataFrame, text: str = "text", keys: Sequence[str] = ("model",)) -> DataFrame:
    """Binary metrics over all rows and over every text group."""
    names = F.concat(F.array(F.lit("all")), text_groups(F.col(text)))
    # Written once: the metrics read these rows many times, and the texts are many times their size.
    rows = cut_lineage(scored.withColumn("text_group", F.explode(names)).select(*keys, "text_group", "probability", "label"))
    by = [*keys, "text_group"]
    base = metrics.binary_metrics(rows, by)
    area = metrics.auroc(rows, by)
    gap = metrics.calibration_error(metrics.reliability(rows, by), by)
    return base.join(area, by).join(gap, by)


def origin_benchmark(rows: DataFrame, epochs: int = 12) -> Tables:
    """Hashed-text and length classifiers: fit, calibrate on validation, score the test part once."""
    parts = rows.withColumn("part", F.col("split"))
    by_length = fitting.length_features(parts)
    fitted, tested = F.col("part") != "test", F.col("part") == "test"
    hashed = fitting.fit_texts(parts.filter(fitted), epochs)
    length = fitting.fit_logistic(by_length.filter(fitted), 1, epochs)
    scored = []
    picks = []
    for name, model, test in (
        ("hashed_text", hashed, parts.filter(tested).withColumn("logit", hashed.text_logit_udf()("text"))),
        ("length_baseline", length, by_length.filter(tested).withColumn("logit", length.logit_udf()("indices", "values"))),
    ):
        picks.append((name, model.selected_epoch, float(model.temperature), model.validation_nll))
        # Written once, without the features, which every table below would derive again.
        test = cut_lineage(test.select("answer_sha256", "label", "text", "logit"))
        for suffix, t in (("", model.temperature), ("_uncalibrated", 1.0)):
            scored.append(
                test.select(
                    "answer_sha256",
                    "label",
                    "text",
                    F.lit(name + suffix).alias("model"),
                    "logit",
                    numeric.sigmoid(F.col("logit") / F.lit(float(t))).alias("probability"),
                )
            )
    predictions = scored[0]
    for part in scored[1:]:
        predictions = predictions.unionByName(part)
    spark = rows.sparkSession
    supported = F.array_contains(text_groups(F.col("text")), "inference_supported_long_cjk")
    return {
        "predictions": predictions,
        "metrics": subgroup_metrics(predictions),
        "selected": spark.createDataFrame(picks, "model string, selected_epoch int, temperature double, validation_nll double"),
        "decision_coverage": metrics.coverage_share(parts.filter(F.col("part") == "test"), supported, name="decision_coverage"),
    }


def classify_answers(rows: DataFrame, model: fitting.LogisticModel, own_domain: str) -> DataFrame:
    """Gated scoring: refused rows carry the reason and no probability; only the rest is scored."""
    ready = rows.withColumn("_text", normalise("answer"))
    gated = ready.withColumn("reason", decision_gate(F.col("_text"), F.col("domain"), F.col("task"), own_domain))
    refused = gated.filter(F.col("reason").isNotNull()).drop("_text").withColumn(
        "probability", F.lit(None).cast("double")
    ).withColumn("decision", F.lit("unknown"))
    kept = gated.filter(F.col("reason").isNull()).withColumn("_f", hashed_features("_text"))
    logit = model.logit_udf()(F.col("_f.indices"), F.col("_f.values"))
    scored = kept.withColumn("probability", numeric.sigmoid(logit / F.lit(float(model.temperature))))
    scored = scored.withColumn("decision", F.when(F.col("probability") >= 0.5, "ai_generated").otherwise("human_written"))
    scored = scored.withColumn("reason", F.lit("conditional_binary_domain_estimate_only")).drop("_text", "_f")
    return refused.unionByName(scored)


def origin_features(predictions: DataFrame, features: DataFrame, training: DataFrame, strict: bool = False) -> Tables:
    """Admissible soft features of external origin predictions and every reason for refusal."""
    ok, bad = validation.split(predictions, leakage.prediction_rules())
    checked = leakage.admit_features(features, ok)
    broken = checked.filter(F.col("rule").isNotNull()).select("prediction_id").union(
        leakage.repeated_features(features).select("prediction_id")
    ).distinct()
    recorded = features.select("prediction_id").distinct()
    clean = ok.join(broken, "prediction_id", "left_anti").join(recorded, "prediction_id", "left_semi")
    audits = leakage.training_audit(clean, training)
    return {
        "features": leakage.soft_features(clean, audits, strict),
        "estimates": leakage.estimates(ok),
        "audits": audits,
        "rejected_predictions": bad,
        "rejected_features": checked.filter(F.col("rule").isNotNull()),
    }


def origin_evaluate(predictions: DataFrame, labels: DataFrame, evaluation_at: Column) -> Tables:
    """Brier score and log loss of origin predictions against evidenced labels."""
    ok, bad = validation.split(labels, leakage.label_rules())
    return {"scores": leakage.evaluate_origin(predictions, ok, evaluation_at), "rejected_labels": bad}


def plan_updates(accounts: DataFrame, followers: DataFrame, blues: DataFrame, cohorts: DataFrame, published: DataFrame, now: Column, min_interval_minutes: int = 60) -> Tables:
    state = progress.material_state(accounts, followers, blues, cohorts)
    return {"state": state, "plans": progress.plan_updates(state, published, now, min_interval_minutes)}


def metric_rows(tables: Tables) -> DataFrame:
    return progress.headline_rows(
        tables["follower_observations"], tables["blue_cohort"], tables["blue_observations"]
    )

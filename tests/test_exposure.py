import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tallyscope.functions import numeric
from tallyscope.operators import exposure, validation
from tallyscope.plans import fitting, reports

from .conftest import at, rows

URL = "https://x.com/a/status/1"


def collections(spark, points, published=0, owner=()):
    posts = spark.createDataFrame([(0, URL, at(published), None, None)], "index int, url string, published_at timestamp, observed_at timestamp, views bigint")
    cols = "index int, url string, published_at timestamp, observed_at timestamp, {} bigint"
    pub = spark.createDataFrame([(i, URL, None, at(t), v) for i, (t, v) in enumerate(points)], cols.format("views"))
    own = spark.createDataFrame([(i, URL, None, at(t), v) for i, (t, v) in enumerate(owner)], cols.format("impressions"))
    return {"posts": posts, "post_observations": pub, "analytics_observations": own}


def test_rolling_origin_predictions_and_summary(spark):
    out = reports.exposure_backtest(collections(spark, [(60, 10), (120, 20), (180, 25), (240, 40)]))
    got = rows(out["predictions"].select("model", "target_at", "prediction", "actual", "latest_holdout", "training_points"), "target_at", "model")
    assert [(g[0], g[2], g[3], g[4], g[5]) for g in got] == [
        ("constant", 20.0, 25, False, 2), ("recent_rate", 30.0, 25, False, 2), ("constant", 25.0, 40, True, 3), ("recent_rate", 30.0, 40, True, 3)]
    rate = out["summary"].filter("model = 'recent_rate'").first()
    assert rate.mae == 7.5 and abs(rate.rmse - math.sqrt(62.5)) < 1e-12 and rate.n_posts == 1 and rate.latest_mae == 10
    assert out["forecasts"].first().recent_rate == 40 + 15 / 60 * (86400 - 240)
    assert out["skipped"].first().skip_reason == "missing_observed_at"


def test_prediction_ignores_later_points(spark):
    a = reports.exposure_backtest(collections(spark, [(60, 10), (120, 20), (180, 25)]))["predictions"]
    b = reports.exposure_backtest(collections(spark, [(60, 10), (120, 20), (180, 25), (999, 10**6)]))["predictions"]
    early = F.col("target_at") <= F.lit(at(180))
    assert rows(a.select("model", "prediction"), "model") == rows(b.filter(early).select("model", "prediction"), "model")


def test_surfaces_are_never_pooled_and_revisions_disable_a_series(spark):
    out = reports.exposure_backtest(collections(spark, [(60, 10), (120, 9), (180, 25)], owner=[(60, 1), (120, 2), (180, 3)]))
    assert {r.source for r in out["predictions"].collect()} == {"owner_impressions"}
    assert {r.source: r.status for r in out["series"].collect()} == {"public_views": "counter_revision", "owner_impressions": "usable"}


def test_conflicts_and_early_captures_are_rejected(spark):
    out = reports.exposure_backtest(collections(spark, [(60, 10), (60, 11), (5, 1), (120, 12), (120, 12)], published=10))
    assert sorted(r.rule for r in out["rejected"].collect()) == ["conflicting_counters", "observed_before_publication"]
    assert out["series"].first().n_points == 1


def curve_points():
    ages = [200 * (i + 1) for i in range(9)]
    return [(t, int(5 + 400 * (1 - math.exp(-t / 1500)))) for t in ages]


def test_curve_fit_paths_agree(spark):
    points = exposure.load_series(exposure.stack_collections(collections(spark, curve_points())))[0]
    base = exposure.unrevised(points)
    key = ["position", "base", "amplitude", "tau_seconds", "training_loss", "n_training_points"]
    pdf = base.select("position", "age_seconds", "value").toPandas()
    for only_last in (False, True):
        want = fitting.fit_prefixes(pdf, 6, only_last)[key].to_numpy(float)
        bundled = fitting.saturation_fits(base, 6, only_last)
        blocks = fitting.saturation_fits(base, 6, only_last, long_series=3, point_block=4, prefix_block=2)
        for got in (bundled, blocks):
            assert np.allclose(np.array(rows(got.select(key), "position"), float), want, rtol=1e-9)
    assert [r[0] for r in rows(bundled.select(key))] == [9]


def test_bundles_hold_many_series(spark, monkeypatch):
    monkeypatch.setattr(fitting, "BATCH_POINTS", 50)
    data, want = [], {}
    for k in range(12):
        n = 3 + k
        own = [(f"u{k}", "s", i + 1, 300.0 * (i + 1) + k, 5 + 17 * i * (k + 1)) for i in range(n)]
        data += own
        frame = pd.DataFrame(own, columns=["url", "source", "position", "age_seconds", "value"])
        for r in fitting.fit_prefixes(frame, 40).itertuples():
            want[f"u{k}", r.position] = (r.base, r.amplitude, r.tau_seconds, r.training_loss)
    # A third of all points in one series, which is cut into blocks.
    long = [("long", "s", i + 1, 200.0 * (i + 1), 10 * i) for i in range(40)]
    for r in fitting.fit_prefixes(pd.DataFrame(long, columns=["url", "source", "position", "age_seconds", "value"]), 3).itertuples():
        want["long", r.position] = (r.base, r.amplitude, r.tau_seconds, r.training_loss)
    schema = "url string, source string, position bigint, age_seconds double, value bigint"
    got = fitting.saturation_fits(spark.createDataFrame(data, schema).repartition(4), 40)
    cut = fitting.saturation_fits(spark.createDataFrame(data[:12] + long, schema).repartition(4), 3, long_series=30, point_block=16, prefix_block=8)
    found = {(r.url, r.position): (r.base, r.amplitude, r.tau_seconds, r.training_loss) for r in [*got.collect(), *cut.filter("url = 'long'").collect()]}
    assert set(found) == set(want)
    assert all(np.allclose(found[k], want[k], rtol=1e-9) for k in want)
    assert {r.url for r in cut.select("url").distinct().collect()} >= {"long"}


def test_curve_gradient_is_the_derivative():
    ages, counts = np.array([0.1, 0.5, 1.0, 2.0]), np.array([3.0, 8.0, 11.0, 20.0])
    raw, mask = np.array([[0.3, 1.2, -0.4]]), np.ones((1, 4), bool)
    _, slope = fitting.curve_gradient(raw, ages, counts, mask)
    for k in range(3):
        step = np.zeros((1, 3))
        step[0, k] = 1e-6
        up, down = (fitting.curve_gradient(raw + s, ages, counts, mask)[0][0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - slope[0, k]) < 1e-5


def test_injected_fitter_and_matched_comparison(spark):
    seen = []

    def fake(pdf, epochs, last_only):
        seen.append(len(pdf))
        return pd.DataFrame({"position": [3], "base": [0.0], "amplitude": [100.0], "tau_seconds": [60.0], "training_loss": [0.0], "n_training_points": [3], "fit_status": ["experimental_fit"]})

    out = reports.exposure_backtest(collections(spark, [(60, 10), (120, 20), (180, 25), (240, 40), (300, 50)]), curve=True, fit_fn=fake)
    curve = out["predictions"].filter(F.col("model") == fitting.CURVE_MODEL).collect()
    assert len(curve) == 1 and abs(curve[0].prediction - (25 + 100 * (math.exp(-3) - math.exp(-4)))) < 1e-9
    assert {r.n_predictions for r in out["matched_summary"].collect()} == {1}
    assert out["matched_guard"].first().equal_samples


def test_popular_pool_keeps_five_per_author_and_total(spark):
    draw = random.Random(1)
    data = [(f"u{i}", "a" if i % 3 else f"a{i}", draw.random()) for i in range(60)] + [("late", "b", None)]
    df = spark.createDataFrame(data, "url string, author string, score double")
    got = exposure.popular_pool(df, "author", 5, 20).collect()
    by_author = {}
    for u, a, s in sorted((x for x in data if x[2] is not None), key=lambda x: (-x[2], x[0])):
        by_author.setdefault(a, []).append((u, s))
    want = sorted(((u, s) for v in by_author.values() for u, s in v[:5]), key=lambda x: (-x[1], x[0]))[:20]
    assert [(r.url, r.score) for r in got] == want


def test_horizon_edges(spark):
    df = spark.createDataFrame([(s,) for s in (900, 901, 3600, 21600, 86400, 86401)], "s int").select(numeric.horizon_bucket(F.col("s")))
    assert [r[0] for r in df.collect()] == ["0_to_15_minutes", "15_to_60_minutes", "15_to_60_minutes", "1_to_6_hours", "6_to_24_hours", "over_24_hours"]


def sealed_inputs(spark, reads, declared=True, **change):
    base = {"forecast_id": "f", "post_url": "https://x.com/a/status/1", "version": "v", "source": "public_views", "metric": "views", "post_id": "1", "status": "frozen_before_target",
            "published_at": at(0), "origin_at": at(1800), "input_cutoff_at": at(1800), "generated_at": at(1900), "frozen_at": at(1950), "target_at": at(3600), "accepted_from": at(3600),
            "accepted_to": at(3900), "early_tolerance_seconds": 0, "late_tolerance_seconds": 300, "n_numeric_points": 2} | change
    types = {"n_numeric_points": "bigint", "early_tolerance_seconds": "int", "late_tolerance_seconds": "int"}
    schema = ", ".join(f"{k} {types.get(k, 'timestamp' if k.endswith('_at') or k.startswith('accepted') else 'string')}" for k in base)
    forecasts = spark.createDataFrame([tuple(base.values())], schema)
    inputs = spark.createDataFrame([("f", i, "public_views", at(t), None, None, None, v) for i, (t, v) in enumerate([(900, 8), (1800, 10)])],
                                   "forecast_id string, index int, source string, observed_at timestamp, started_at timestamp, completed_at timestamp, available_at timestamp, value bigint")
    caps = spark.createDataFrame([(*list(base.values())[:5], v, at(t), at(t - 5), at(t), None) for t, v in reads],
                                 "forecast_id string, post_url string, version string, source string, metric string, actual bigint, observed_at timestamp, observation_started_at timestamp, observation_completed_at timestamp, available_at timestamp")
    preds = spark.createDataFrame([("f", "constant", 14.0), ("f", "none", None)], "forecast_id string, model string, point_prediction double")
    decl = spark.createDataFrame([("f", declared, None)], "forecast_id string, first_read_declared boolean, history_complete_declared boolean")
    return forecasts, inputs, preds, caps, decl


def test_first_numeric_read_after_target_is_scored(spark):
    out = reports.evaluate_forecasts(*sealed_inputs(spark, [(3500, 14), (3600, None), (3628, 28), (3610, 20)]))
    e = out["evaluations"].first()
    assert (e.actual, e.evaluation_status, e.lateness_seconds, e.eligible_primary_comparison) == (20, "delayed_proxy", 10.0, True)
    m = {r.model: r for r in out["models"].collect()}
    assert abs(m["constant"].smape_percent - 1200 / 34) < 1e-12 and m["none"].absolute_error is None


def test_sealed_statuses_and_rejections(spark):
    def status(reads, **kw):
        return reports.evaluate_forecasts(*sealed_inputs(spark, reads, **kw))

    assert status([])["evaluations"].first().evaluation_status == "pending"
    assert status([(3500, 14)])["evaluations"].first().evaluation_status == "early"
    assert status([(3602, 14)])["evaluations"].first().evaluation_status == "early_or_straddling_capture"
    assert status([(4000, 14)])["evaluations"].first().evaluation_status == "outside_window"
    late = status([(3610, 3)])["evaluations"].first()
    assert late.apparent_revision and late.target_window_eligible and not late.eligible_primary_comparison
    assert status([(3610, 20)], declared=False)["undeclared"].count() == 1
    assert status([(3610, 20), (3610, 21)])["rejected_captures"].first().rule == "conflicting_capture"
    assert status([(3610, 20)], frozen_at=at(3600))["rejected_forecasts"].first().rule == "clock_order"
    assert status([(3610, 20)], late_tolerance_seconds=301, accepted_to=at(3901))["rejected_forecasts"].first().rule == "late_budget"
    assert status([(3610, 20)], n_numeric_points=3)["rejected_inputs"].first().input_rule == "input_count_mismatch"


def test_equal_sample_guard(spark):
    df = spark.createDataFrame([("s", "h", 3, 2), ("s", "h", 3, 1)], "source string, horizon_bucket string, n_predictions int, n_posts int")
    assert not validation.equal_sample_guard(df).first().equal_samples


def test_targets_belong_to_their_key_and_two_for_one_key_are_refused(spark):
    from tallyscope.plans import reports

    schema = "series string, metric string, observed_at timestamp, verified_home_impressions_90d long, verified_followers long, source string, replies_excluded boolean, payout_qualified_impressions long"
    rows = spark.createDataFrame([(s, m, at(0), 50, 5, "e", True, None) for s, m in (("a", "x"), ("b", "y"), ("c", "z"))], schema)
    goals = spark.createDataFrame([("x", 90, 100, 10), ("y", 90, 200, 20), ("y", 90, 300, 30)], "metric string, window_days int, impression_target long, verified_follower_target long")
    got = reports.rolling_progress(rows, goals, ["series"], "e")
    assert [(r.series, r.impression_deficit) for r in got["latest"].collect()] == [("a", 50)]
    assert sorted((r.series, r.rule) for r in got["rejected"].collect()) == [("b", "several_targets"), ("c", "window_days")]


def test_a_callers_fitter_runs_for_every_series(spark):
    import pandas as pd

    from tallyscope.plans import fitting

    def fit(pdf, epochs, last_only):
        return pd.DataFrame([{"position": len(pdf), "base": 1.0, "amplitude": 1.0, "tau_seconds": 1.0, "training_loss": 0.0, "n_training_points": len(pdf), "fit_status": "experimental_fit"}])

    base = spark.range(40).selectExpr("concat('u', id % 2) AS url", "'s' AS source", "cast(id / 2 AS bigint) + 1 AS position", "cast(id AS double) AS age_seconds", "id AS value")
    assert sorted((r.url, r.position) for r in fitting.saturation_fits(base, fit_fn=fit).collect()) == [("u0", 20), ("u1", 20)]


def test_fit_blocks_of_both_layouts_match_plain_fits():
    draw = np.random.default_rng(5)
    frames, want = [], {}
    for k, n in enumerate([*draw.integers(2, 12, 40), 90]):
        own = pd.DataFrame({"url": f"u{k}", "source": "s", "position": np.arange(1, n + 1), "age_seconds": np.sort(draw.uniform(60, 9e5, n)), "value": np.sort(draw.integers(0, 5000, n))})
        frames.append(own)
        for r in fitting.fit_prefixes(own, 30).itertuples():
            want[f"u{k}", r.position] = (r.base, r.amplitude, r.tau_seconds, r.training_loss)
    sizes = np.array([p for _, p in want])
    blocks = list(fitting._blocks(sizes))
    assert sorted(np.concatenate(blocks)) == list(range(len(sizes)))
    # Hundreds of prefixes of many lengths take few numpy calls, and no block is much larger than its points.
    assert len(blocks) < 12 and all(sizes[b].max() * len(b) <= 1.2 * sizes[b].sum() + fitting.BATCH_POINTS // 8 for b in blocks)
    assert {len(b) > sizes[b].max() for b in blocks} == {True, False}
    got = fitting._bundle_fitter(30, False)(pd.concat(frames).sample(frac=1, random_state=2))
    found = {(r.url, r.position): (r.base, r.amplitude, r.tau_seconds, r.training_loss) for r in got.itertuples()}
    assert set(found) == set(want) and all(np.allclose(found[k], want[k], rtol=1e-9) for k in want)

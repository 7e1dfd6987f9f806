import pytest
from pyspark.sql import functions as F

from tallyscope import schemas
from tallyscope.operators import cascades, metrics, splits, validation
from tallyscope.plans import fitting, minibatch, reports
from tallyscope.sources import readers

from .conftest import rows

TIMES = ["0", "0", "0", "900", "901", "3600", "3601", "8.64e4", "86401"]


def corpus(tmp_path, ids=("10", "010", "7", "7", "-3", "x", "99")):
    index, events, line = ["tweet_id,post_time_day,start_ind,end_ind"], ["relative_time_second,number_of_followers"], 1
    for i, name in enumerate(ids):
        index.append(f"{name},{i}.5,{line},{line + len(TIMES) - 1}")
        events += [f"{t},5" for t in TIMES]
        line += len(TIMES)
    (tmp_path / "index.csv").write_text("\n".join(index) + "\n")
    (tmp_path / "events.csv").write_text("\n".join(events) + "\n")
    return str(tmp_path / "index.csv"), str(tmp_path / "events.csv")


def test_prepared_features_and_quarantine(spark, tmp_path):
    a, b = corpus(tmp_path)
    out = reports.prepare_cascades(readers.cascade_index(spark, a), readers.cascade_events(spark, b), probes=None)
    got = out["features"].filter("cascade_id = 'cascade-000001'").orderBy("cutoff_seconds").collect()
    # Eight events after the origin: two at zero, then the boundaries of both cutoffs and of the day.
    assert [(r.observed_retweet_count, r.future_retweets_to_24h, r.total_retweets_at_24h) for r in got] == [(3, 4, 7), (5, 2, 7)]
    assert (got[0].first_observed_retweet_seconds, got[0].last_observed_retweet_seconds, got[1].last_observed_retweet_seconds) == (0.0, 900.0, 3600.0)
    assert rows(out["quarantine"].select("segment_index"), "segment_index") == [(2,), (3,), (4,), (5,), (6,)]
    c = out["coverage"].first()
    assert (c.index_rows, c.repeated_id_count, c.usable_unique_cascades, c.quarantined_segments, c.indexed_event_rows) == (7, 1, 2, 5, 63)
    s = out["anomalies"].first()
    assert (s.scientific_notation_event_times, s.segments_below_documented_50_retweets, s.maximum_event_second, s.unsorted_event_transitions) == (7, 7, 86401.0, 0)
    assert out["broken_ranges"].isEmpty() and out["bad_origins"].isEmpty()
    assert out["recount"].filter("NOT matches").isEmpty() and out["recount"].count() == 4


def test_ordinals_follow_file_order(spark, tmp_path):
    text = "relative_time_second,number_of_followers\n" + "".join(f"{i},1\n" for i in range(30000))
    (tmp_path / "e.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = readers.cascade_events(spark, str(tmp_path / "e.csv"))
        assert df.filter("ordinal <> cast(relative_time_second as bigint) + 1").isEmpty() and df.count() == 30000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_range_join_spreads_a_huge_segment(spark):
    index = spark.createDataFrame([(1, 1, 10), (2, 11, 3_000_000), (3, 3_000_001, 3_000_002)], "sequence bigint, start_ind bigint, end_ind bigint")
    assert cascades.segment_cells(index).filter("sequence = 2").count() == 3_000_000 // 1024 + 1
    events = spark.createDataFrame([(i, "0") for i in (1, 10, 11, 1024, 1025, 1_048_576, 2_999_999, 3_000_000, 3_000_001, 3_000_003)], "ordinal bigint, relative_time_second string")
    assert rows(cascades.assign_events(index, events).select("ordinal", "sequence", "is_origin"), "ordinal") == [
        (1, 1, True), (10, 1, False), (11, 2, True), (1024, 2, False), (1025, 2, False), (1_048_576, 2, False), (2_999_999, 2, False), (3_000_000, 2, False), (3_000_001, 3, True)]


def test_header_is_pinned(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("post_time_day,tweet_id,start_ind,end_ind\n1,1,1,1\n")
    with pytest.raises(Exception):
        readers.cascade_index(spark, str(tmp_path / "bad.csv")).collect()


def test_split_boundaries(spark):
    days = [0.5, 3.0, 3.5, 4.0, 5.999, 6.0, 6.5, 7.0, 14.999]
    df = spark.createDataFrame([(d,) for d in days], "d double")
    got = df.select(splits.strict_split(F.col("d")), splits.inner_split(F.col("d"))).collect()
    assert [g[0] for g in got] == ["train_candidate"] * 6 + ["purged_label_overlap"] + ["evaluation_candidate"] * 2
    assert [g[1] for g in got[:6]] == ["fit", "fit", "purged", "validation", "validation", "purged"]


def test_poisoned_labels_of_other_days_do_not_matter(spark, tmp_path):
    head = ",".join(schemas.FEATURE_COLUMNS)
    good = "cascade-000001,1.0,900,train_candidate,train_candidate,1,5,5,2,3,2.0"
    bad = "cascade-000002,8.0,900,evaluation_candidate,evaluation_candidate,1,5,5,POISON,POISON,9.0"
    (tmp_path / "f.csv").write_text("\n".join([head, good, bad]) + "\n")
    admitted, skipped = readers.label_blind_features(spark, str(tmp_path / "f.csv"))
    assert [(r.cascade_id, r.future_retweets_to_24h) for r in admitted.collect()] == [("cascade-000001", 2)]
    assert [tuple(r) for r in skipped.collect()] == [("not_training_day", 1)]


def feature_rows(spark, n=240):
    data = []
    for i in range(n):
        day = (i % 14) + 0.25
        early, late, total = i % 5, i % 5 + i % 7, (i % 5 + i % 7) + (i * 7) % 40
        for cutoff, seen in ((900, early), (3600, late)):
            first, last = (10.0, 10.0) if seen == 1 else (10.0, cutoff - 10.0)
            if early:
                first = 10.0
            elif seen:
                first = last = 1000.0
            if early == late and early:
                last = 10.0 if early == 1 else 890.0
            data.append((f"cascade-{i:06d}", day, cutoff, "train_candidate" if day < 7 else "evaluation_candidate",
                         "train_candidate" if day + 1 <= 7 else "purged_label_overlap" if day < 7 else "evaluation_candidate",
                         seen, first if seen else None, last if seen else None, total - seen, total, day + 1))
    return spark.createDataFrame(data, schemas.FEATURE_ROWS)


def test_row_and_pair_rules(spark):
    df = feature_rows(spark, 20)
    _, bad = validation.split(df, validation.feature_row_rules())
    assert bad.isEmpty()
    broken = df.withColumn("total_retweets_at_24h", F.when(F.col("cascade_id") == "cascade-000003", 9999).otherwise(F.col("total_retweets_at_24h")))
    _, bad = validation.split(broken, validation.feature_row_rules())
    assert {r.rule for r in bad.collect()} == {"total_mismatch"}
    lone = validation.paired_cutoffs(df.filter("NOT (cascade_id = 'cascade-000004' AND cutoff_seconds = 900)"))
    assert [r.cascade_id for r in lone.filter("rule = 'cutoff_missing'").collect()] == ["cascade-000004"]


def test_baselines_and_fallback(spark):
    train = spark.createDataFrame([(900, 0, 1), (900, 0, 3), (900, 1, 10), (900, 5, 100)], "cutoff_seconds int, observed_retweet_count bigint, future_retweets_to_24h bigint")
    overall, buckets = metrics.fit_baselines(train)
    test = spark.createDataFrame([("c", 900, 0, 4), ("d", 900, 1000, 4)], "cascade_id string, cutoff_seconds int, observed_retweet_count bigint, future_retweets_to_24h bigint")
    a, b = metrics.baseline_predictions(test, overall, buckets).orderBy("cascade_id").collect()
    assert (a.train_log_count_bucket_median, a.constant_train_median, b.train_log_count_bucket_median, b.early_constant_rate) == (2.0, 6.5, 6.5, 95000.0)


def test_count_and_interval_metrics(spark):
    df = spark.createDataFrame([(0, 1.0), (10, 7.0), (20, 20.0)], "actual bigint, prediction double")
    m = metrics.count_metrics(df, []).first()
    assert (m.n_cascades, m.median_absolute_error, m.wape, m.bias_predicted_minus_actual) == (3, 1.0, 4 / 30, -2 / 3)
    assert abs(m.p90_absolute_error - 2.6) < 1e-12
    assert metrics.count_metrics(df.filter("actual = 0"), []).first().wape is None
    spans = spark.createDataFrame([(5, 0.0, 10.0), (11, 0.0, 10.0)], "actual bigint, lower double, upper double")
    s = metrics.interval_metrics(spans, []).first()
    assert (s.interval_80_empirical_coverage, s.interval_80_mean_width) == (0.5, 10.0)
    loss = metrics.pinball_loss(spark.range(1), [], F.lit(5.0), {0.1: F.lit(1.0), 0.5: F.lit(4.0), 0.9: F.lit(7.0)}).first().pinball_loss
    assert abs(loss - (0.4 + 0.5 + 0.2) / 3) < 1e-12


def test_binary_metrics_and_calibration(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.6), (1, 0.9)], "label int, probability double")
    m = metrics.binary_metrics(df, []).first()
    assert m.accuracy == 1 and abs(m.brier - 0.085) < 1e-12 and m.small_group
    assert metrics.auroc(df, []).first().auroc == 1
    assert abs(metrics.calibration_error(metrics.reliability(df, []), []).first().ece - 0.25) < 1e-12
    tied = spark.createDataFrame([(0, 0.5), (1, 0.5)], "label int, probability double")
    assert metrics.auroc(tied, []).first().auroc == 0.5
    assert metrics.auroc(tied.filter("label = 1"), []).first().auroc is None
    grid = metrics.temperature_grid(spark.createDataFrame([(0.0, 1)], "logit double, label int"), [])
    assert metrics.choose_temperature(grid, []).first().temperature == 1.0


def test_network_gradient_is_the_derivative():
    import numpy as np

    draw = np.random.default_rng(0)
    x, y = draw.normal(size=(7, 5)), draw.uniform(0, 4, 7)
    for kind in ("count", "quantile"):
        theta = fitting.initial_parameters(kind, 4) * 1.7
        _, slope = fitting.loss_and_gradient(theta, x, y, kind)
        for k in range(0, len(theta), 17):
            step = np.zeros_like(theta)
            step[k] = 1e-6
            up, down = (fitting.loss_and_gradient(theta + s, x, y, kind)[0] for s in (step, -step))
            assert abs((up - down) / 2e-6 - slope[k]) < 1e-4
    assert (fitting.parameter_count("count"), fitting.parameter_count("quantile")) == (241, 259)


def test_benchmark_and_quantiles_run_end_to_end(spark):
    df = feature_rows(spark)
    out = reports.cascade_benchmark(df, epochs=3)
    assert out["metrics"].count() == 2 * 5 * 3
    assert all(r.within_tolerance for r in out["parity"].collect())
    q = reports.cascade_quantiles(df, epochs=2)
    assert q["disorder"].isEmpty() and q["selected"].count() == 2


def test_fit_does_not_depend_on_partitioning(spark):
    import numpy as np

    data = fitting.training_rows(feature_rows(spark), 900)
    one = fitting.fit_network(data.coalesce(1), "count", 3, steps_per_epoch=2, validation_part=F.col("part") == "validation")
    many = fitting.fit_network(data.repartition(7), "count", 3, steps_per_epoch=2, validation_part=F.col("part") == "validation")
    assert np.allclose(one.theta, many.theta, rtol=1e-9) and one.selected_epoch == many.selected_epoch


def numpy_loop(rows, kind, seed, epochs, batch, used, scales):
    """Mini-batches on the driver: the same rows in the same batches, one after the other."""
    import numpy as np

    x, target, keys = np.array([r.x for r in rows]), np.array([r.target for r in rows]), np.array([r.key for r in rows], np.int64).view(np.uint64)
    fit = np.array([r.part in used for r in rows])
    held = np.array([r.part == "validation" for r in rows])
    mean, scale = scales
    x = (x - mean) / scale
    theta, adam = fitting.initial_parameters(kind, seed), fitting.Adam(0.01)
    batches, errors, saved = -(-int(fit.sum()) // batch), [], []
    for epoch in range(epochs):
        place = minibatch.batch_of(keys, seed, epoch, batches)
        for step in range(batches):
            own = fit & (place == step)
            if own.any():
                theta = adam.step(theta, fitting.loss_and_gradient(theta, x[own], np.log1p(target[own]), kind)[1] / own.sum())
        logs = fitting.forward(theta, x[held], kind)[0][:, 0 if kind == "count" else 1]
        errors.append(np.abs(fitting.counts_from_logs(logs) - target[held]).mean() if held.any() else np.inf)
        saved.append(theta)
    best = int(np.argmin(errors))
    return saved[best], best + 1, theta


def test_barrier_batches_equal_the_numpy_loop(spark):
    import numpy as np

    df = feature_rows(spark)
    parts = {r.part for r in fitting.training_rows(df, 900).select("part").distinct().collect()}
    assert {"fit", "validation"} <= parts
    wanted = [minibatch.Candidate(c, k, 7 + c, refit=k == "count") for c in (900, 3600) for k in ("count", "quantile")]
    models = minibatch.fit_candidates(df.repartition(5), wanted, 6, 16)
    for spec, model in zip(wanted, models, strict=True):
        frame = fitting.training_rows(df, spec.cutoff).withColumn("key", F.xxhash64("cascade_id"))
        data = frame.collect()
        best, epoch, _ = numpy_loop(data, spec.kind, spec.seed, 6, 16, {"fit"}, fitting.feature_scale(frame.filter("part = 'fit'")))
        assert model.selected_epoch == epoch
        if spec.refit:
            best = numpy_loop(data, spec.kind, spec.seed, epoch, 16, parts, fitting.feature_scale(frame))[2]
        assert np.allclose(model.theta, best, rtol=1e-9, atol=1e-12)
    # Alone, a candidate gives what it gives beside the others.
    (alone,) = minibatch.fit_candidates(df, wanted[1:2], 6, 16)
    assert alone.selected_epoch == models[1].selected_epoch and np.allclose(alone.theta, models[1].theta, rtol=1e-9, atol=1e-12)


def test_tasks_average_after_each_epoch(spark):
    import numpy as np

    df, spec = feature_rows(spark), [minibatch.Candidate(900, "count", 5)]
    one, other = (minibatch.fit_candidates(df.repartition(k), spec, 3, 16, tasks=3)[0] for k in (2, 6))
    assert np.allclose(one.theta, other.theta, rtol=1e-9, atol=1e-12) and len(one.history) == 3
    assert one.history[0]["validation_mae"] == pytest.approx(other.history[0]["validation_mae"])


def test_batches_are_seeded_and_near_their_size():
    import numpy as np

    keys = np.random.default_rng(1).integers(0, 2**63, 40_960).astype(np.uint64)
    first, again, other = (minibatch.batch_of(keys, 3, e, 10) for e in (0, 0, 1))
    assert (first == again).all() and (first != other).mean() > 0.8
    assert np.abs(np.bincount(first, minlength=10) - 4096).max() < 300


def test_optimiser_refuses_foreign_rows(spark):
    df = spark.createDataFrame([([0], [1.0], 1, "test")], "indices array<int>, values array<double>, label int, part string")
    with pytest.raises(ValueError):
        fitting.fit_logistic(df, 1)


def test_networks_score_a_row_once(spark):
    q = reports.cascade_quantiles(feature_rows(spark), epochs=1)
    for name in ("predictions", "metrics"):
        assert "zip_with" not in q[name]._jdf.queryExecution().optimizedPlan().toString()
    got = q["predictions"].collect()
    assert {(r.model, r.lower is None, r.upper is None) for r in got} == {("original_smooth_l1", True, True), ("ordered_quantile_pinball", False, False)}
    assert all(r.median is not None and (r.lower is None or r.lower <= r.median <= r.upper) for r in got)

import random

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import intervals, validation
from tallyscope.streaming import captures

from .conftest import at, rows


@pytest.fixture()
def feed(spark, tmp_path):
    """Write batches as files and stream them one file per trigger."""
    number = iter(range(1000))
    folder = tmp_path / "feed"
    folder.mkdir()

    def add(df):
        i = next(number)
        df.coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next((tmp_path / f"b{i}").glob("*.parquet"))
        part.rename(folder / f"{i:04d}.parquet")

    def run(build, schema, name):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        query = (
            build(source).writeStream.format("memory").queryName(name).outputMode("append")
            .option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        assert query.exception() is None
        query.stop()
        return spark.table(name)

    return add, run


SCHEMA = "series string, observed_at timestamp, value bigint"


def test_stream_deltas_equal_batch(spark, feed):
    add, run = feed
    draw = random.Random(2)
    data = [(f"s{draw.randint(0, 4)}", at(60 * i), draw.randint(0, 300) if i % 9 else None) for i in range(120)]
    for k in range(0, 120, 40):
        add(spark.createDataFrame(data[k : k + 40], SCHEMA))
    got = run(lambda s: captures.stream_deltas(s, "series", "value"), SCHEMA, "deltas")
    want = intervals.counter_intervals(spark.createDataFrame(data, SCHEMA), ["series"], "value")
    columns = ["series", "started_at", "ended_at", "interval_seconds", "net_delta", "net_rate_per_second", "status"]
    assert rows(got.select(columns), "series", "ended_at") == rows(want.select(columns), "series", "ended_at")


def test_late_and_conflicting_captures_are_named(spark, feed):
    add, run = feed
    add(spark.createDataFrame([("a", at(0), 1), ("a", at(120), 9)], SCHEMA))
    add(spark.createDataFrame([("a", at(60), 5), ("a", at(120), 9), ("a", at(120), 8), ("a", at(180), 10)], SCHEMA))
    got = run(lambda s: captures.stream_deltas(s, "series", "value"), SCHEMA, "late")
    assert sorted((r.status, r.net_delta) for r in got.collect() if r.net_delta is None) == [("conflicting_capture", None), ("late_capture", None)]
    assert sorted(r.net_delta for r in got.collect() if r.net_delta is not None) == [1, 8]


def test_hourly_sums_close_with_the_watermark(spark, feed):
    add, run = feed
    schema = captures.DELTA_SCHEMA
    data = [("a", at(0), at(600), 600.0, 5, 0.0, "observed_counter_change"), ("a", at(600), at(1200), 600.0, -3, 0.0, "counter_revision"), ("a", at(1200), at(4000), 2800.0, 7, 0.0, "observed_counter_change")]
    add(spark.createDataFrame(data, schema))
    add(spark.createDataFrame([("a", at(90000), at(99999), 1.0, 1, 0.0, "observed_counter_change")], schema))
    got = run(lambda s: captures.hourly_deltas(s, "1 hour"), schema, "hourly")
    assert rows(got.select("net_delta", "covered_seconds", "n_revisions"), "covered_seconds") == [(5, 600.0, 1), (7, 2800.0, 0)]


def test_repeats_are_dropped_and_conflicts_flagged(spark, feed):
    add, run = feed
    first = [("a", at(0), 5), ("a", at(60), 6), ("b", at(0), 1)]
    add(spark.createDataFrame(first, SCHEMA))
    add(spark.createDataFrame([("a", at(0), 5), ("a", at(60), 7)], SCHEMA))
    kept = run(lambda s: captures.drop_repeats(s, ["series"], ["value"], "1 hour"), SCHEMA, "kept")
    assert rows(kept.select("series", "value"), "series", "value") == [("a", 5), ("a", 6), ("a", 7), ("b", 1)]
    flagged = run(lambda s: captures.flag_conflicts(s, "series", ["value"], "1 hour"), SCHEMA, "flagged")
    every = spark.createDataFrame([*first, ("a", at(0), 5), ("a", at(60), 7)], SCHEMA)
    batch = validation.capture_conflicts(every, ["series"], ["value"]).filter("capture_status = 'conflict'")
    assert rows(flagged.select("series", "observed_at")) == rows(batch.select("series", "observed_at"))


def test_sealed_forecasts_are_scored_or_expire(spark, feed):
    add, run = feed
    schema = "forecast_id string, kind string, event_at timestamp, target_us bigint, start_us bigint, end_us bigint, actual bigint, prediction double"

    def us(seconds):
        return int(at(seconds).timestamp() * 1e6)

    def forecast(name):
        return (name, "forecast", at(0), us(3600), None, us(3900), None, 14.0)

    def read(name, t, value, start=None):
        return (name, "capture", at(t), None, us(t if start is None else start), us(t), value, None)

    add(spark.createDataFrame([forecast("f"), forecast("g"), forecast("h"), read("f", 3500, 14)], schema))
    add(spark.createDataFrame([read("f", 3628, 28), read("f", 3610, 20), read("f", 3601, None), read("g", 3950, 9), read("h", 3600, 11)], schema))
    add(spark.createDataFrame([read("z", 9000, 1)], schema))
    add(spark.createDataFrame([read("z", 9001, 1)], schema))
    got = run(lambda s: captures.score_sealed(s, "10 minutes"), schema, "sealed")
    assert rows(got, "forecast_id") == [
        ("f", "delayed_proxy", 20, 10.0, 14.0, 6.0), ("g", "outside_window", None, None, 14.0, None), ("h", "exact_target_observation", 11, 0.0, 14.0, 3.0)]


def test_any_order_within_the_delay_gives_the_batch_rows(spark, feed):
    add, run = feed
    draw = random.Random(12)
    data = [(f"s{draw.randint(0, 3)}", at(60 * i), draw.randint(0, 300) if i % 9 else None) for i in range(150)]
    # Arrival is up to an hour off; every series ends with a capture far behind, which the watermark never reaches.
    arrivals = sorted(data, key=lambda r: (r[1].timestamp() + draw.randint(0, 3500), r[0]))
    arrivals += [arrivals[3], arrivals[9]]
    for k in range(0, len(arrivals), 38):
        add(spark.createDataFrame(arrivals[k : k + 38], SCHEMA))
    add(spark.createDataFrame([(f"s{k}", at(10**6), 1) for k in range(4)], SCHEMA))
    add(spark.createDataFrame([("s0", at(10**6 + 1), 1)], SCHEMA))
    got = run(lambda s: captures.ordered_deltas(s, "series", "value", "3 hours"), SCHEMA, "ordered")
    want = intervals.counter_intervals(spark.createDataFrame(data, SCHEMA), ["series"], "value")
    columns = ["series", "started_at", "ended_at", "interval_seconds", "net_delta", "net_rate_per_second", "status"]
    assert rows(got.select(columns), "series", "ended_at") == rows(want.select(columns), "series", "ended_at")


def test_values_at_one_instant_conflict_once(spark, feed):
    add, run = feed
    add(spark.createDataFrame([("a", at(120), 9), ("a", at(0), 1), ("a", at(60), 7)], SCHEMA))
    add(spark.createDataFrame([("a", at(60), 5), ("a", at(60), 5), ("a", at(30), 2)], SCHEMA))
    add(spark.createDataFrame([("a", at(50_000), 10)], SCHEMA))
    add(spark.createDataFrame([("b", at(50_000), 10)], SCHEMA))
    got = run(lambda s: captures.ordered_deltas(s, "series", "value", "1 hour"), SCHEMA, "instants")
    assert [(r.net_delta, r.status) for r in got.orderBy("ended_at", "net_delta").collect()] == [
        (1, "observed_counter_change"), (None, "conflicting_capture"), (3, "observed_counter_change"), (4, "observed_counter_change")]


FEED = "forecast_id string, kind string, event_at timestamp, target_us bigint, start_us bigint, end_us bigint, actual bigint, prediction double"


def us(seconds):
    return int(at(seconds).timestamp() * 1e6)


def forecast(name, sent=0, target=3600, end=3900, prediction=14.0):
    return (name, "forecast", at(sent), us(target), None, us(end), None, prediction)


def read(name, t, value):
    return (name, "capture", at(t), None, us(t), us(t), value, None)


def test_a_forecast_sent_again_moves_its_timer(spark, feed):
    add, run = feed
    add(spark.createDataFrame([forecast("f"), forecast("g"), read("f", 3700, 20)], FEED))
    # Later and earlier ends: the old timer must neither fire nor stop the stream.
    add(spark.createDataFrame([forecast("f", 10, 3600, 8000, 30.0), forecast("g", 10, 3600, 3601, 1.0)], FEED))
    add(spark.createDataFrame([read("z", 5600, 1), read("f", 3650, 25)], FEED))
    for t in (7000, 9500, 9501):
        add(spark.createDataFrame([read("z", t, 1)], FEED))
    got = run(lambda s: captures.score_sealed(s, "1 hour"), FEED, "moved")
    assert rows(got, "forecast_id") == [("g", "outside_window", None, None, 1.0, None)]
    add(spark.createDataFrame([read("z", 20_000, 1)], FEED))
    add(spark.createDataFrame([read("z", 20_001, 1)], FEED))
    got = run(lambda s: captures.score_sealed(s, "1 hour"), FEED, "moved_on")
    assert rows(got, "forecast_id") == [
        ("f", "delayed_proxy", 25, 50.0, 30.0, 5.0), ("g", "outside_window", None, None, 1.0, None)]


def test_reads_expire_and_scored_forecasts_are_remembered(spark, feed):
    add, run = feed
    add(spark.createDataFrame([forecast("f"), read("f", 3610, 20), read("early", 3605, 7)], FEED))
    add(spark.createDataFrame([read("z", 5000, 1)], FEED))
    add(spark.createDataFrame([read("z", 5001, 1)], FEED))
    # Scored; a repeat within the time it is kept is not scored again. The early read is still there.
    add(spark.createDataFrame([forecast("f", 5000, 3600, 3900, 99.0), read("f", 5000, 3), forecast("early", 5000, 3600, 6500)], FEED))
    add(spark.createDataFrame([read("z", 9000, 1)], FEED))
    add(spark.createDataFrame([read("z", 9001, 1)], FEED))
    add(spark.createDataFrame([read("orphan", 9002, 1)], FEED))
    add(spark.createDataFrame([read("z", 40_000, 1)], FEED))
    add(spark.createDataFrame([read("z", 40_001, 1)], FEED))
    # Long after: the orphan's read is gone, and f is no longer remembered.
    add(spark.createDataFrame([forecast("orphan", 40_001, 9000, 41_000), forecast("f", 40_001, 40_000, 41_000, 5.0)], FEED))
    add(spark.createDataFrame([read("z", 60_000, 1)], FEED))
    add(spark.createDataFrame([read("z", 60_001, 1)], FEED))
    got = run(lambda s: captures.score_sealed(s, "10 minutes", keep_seconds=5000), FEED, "kept_forecasts")
    assert sorted((r.forecast_id, r.evaluation_status, r.actual, r.point_prediction) for r in got.collect()) == sorted([
        ("f", "delayed_proxy", 20, 14.0), ("early", "delayed_proxy", 7, 14.0),
        ("orphan", "outside_window", None, 14.0), ("f", "outside_window", None, 5.0)])

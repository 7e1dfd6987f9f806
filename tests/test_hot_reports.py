"""Reports give the same rows when every key is treated as hot."""

import random

from pyspark.sql import functions as F

from tallyscope.operators import cascades, documented, intervals, progress
from tallyscope.plans import reports

from .conftest import at, rows
from .test_exposure import collections


def test_backtest(spark):
    draw = random.Random(4)
    points, value = [], 0
    for i in range(40):
        value += draw.randint(0, 9)
        points.append((100 * i + draw.randint(1, 90), value))
    a = reports.exposure_backtest(collections(spark, points, owner=[(10, 5), (20, 4), (30, 9)]))
    b = reports.exposure_backtest(collections(spark, points, owner=[(10, 5), (20, 4), (30, 9)]), hot_rows=4)
    for name in ("predictions", "forecasts", "series"):
        key = [c for c in ("url", "source", "model", "target_at") if c in a[name].columns]
        assert rows(a[name], *key) == rows(b[name].select(a[name].columns), *key)


def test_interval_operators(spark):
    draw = random.Random(6)
    data = [(draw.choice("aab"), i, at(i * 30 + draw.randint(0, 20)), draw.randint(0, 500)) for i in range(120)]
    df = spark.createDataFrame(data, "account string, index int, observed_at timestamp, total bigint").repartition(4)
    a, b = (reports.count_dynamics(df, "total", hot_rows=n) for n in (10**6, 7))
    for name in ("intervals", "accelerations"):
        assert rows(a[name], "account", "ended_at") == rows(b[name].select(a[name].columns), "account", "ended_at")
    x, y = (intervals.last_two_rates(df, ["account"], "total", hot_rows=n) for n in (10**6, 7))
    assert rows(x, "account") == rows(y.select(x.columns), "account")
    rounds = df.select("account", "observed_at", F.lit(True).alias("completed"), (F.col("total") % 2).alias("feedback"), F.lit(0).alias("profile_visits"))
    p, q = (documented.pause_rule(rounds, ["account"], "observed_at", n) for n in (10**6, 7))
    assert rows(p, "account", "observed_at") == rows(q.select(p.columns), "account", "observed_at")
    cand = df.select(F.lit(1).alias("pool"), F.col("account").alias("author"), (F.col("total") / 7.0).alias("score"), F.col("index").alias("id"))
    u, v = (documented.diversity_factor(cand, "pool", "author", "score", "id", n) for n in (10**6, 7))
    assert rows(u, "id") == rows(v.select(u.columns), "id")
    r, s = (progress.legacy_baseline(df.groupBy("account").agg(F.lit(at(2000)).alias("reported_at"), F.lit(at(0)).alias("verified_at")), df, n) for n in (10**6, 7))
    assert rows(r, "account") == rows(s, "account")


def test_unsorted_transitions(spark):
    draw = random.Random(8)
    data = [(1, i, str(draw.randint(0, 50)), i == 1) for i in range(1, 200)]
    df = spark.createDataFrame(data, "sequence bigint, ordinal bigint, relative_time_second string, is_origin boolean")
    want = sum(int(data[i][2]) < int(data[i - 1][2]) for i in range(2, len(data)))
    assert cascades.unsorted_transitions(df).first().unsorted == cascades.unsorted_transitions(df, 9).first().unsorted == want

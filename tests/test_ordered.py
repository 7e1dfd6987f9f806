import random

import numpy as np

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyscope.operators import intervals, ordered
from tallyscope.operators.metrics import tie_ranks

from .conftest import at, rows


def skewed(spark, n=400):
    draw = random.Random(3)
    data = [("hot" if draw.random() < 0.7 else f"k{draw.randint(0, 9)}", i, at(draw.randint(0, 10**6)), draw.randint(0, 99)) for i in range(n)]
    return spark.createDataFrame(data, "k string, id bigint, t timestamp, v bigint").repartition(5)


def test_previous_row_is_the_same_for_cut_keys(spark):
    df = skewed(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select(
        "id", F.lag("id").over(w).alias("p"), F.row_number().over(w).cast("bigint").alias("n"), F.lead("id").over(w).isNull().alias("z")
    )
    for limit in (10**6, 20, 3):
        got = ordered.with_previous(df, ["k"], "t", ["v"], ["id"], limit, flags=True)
        assert rows(got.select("id", "prev.id", "position", "is_last"), "id") == rows(want, "id")
    assert ordered.find_hot(df, ["k"], "t", 20) is not False
    assert ordered.find_hot(df, ["k"], "t") is False


def test_as_of_matches_brute_force(spark):
    df = skewed(spark)
    left = df.filter("id % 3 = 0").select("k", "id", F.col("t").alias("at"))
    right = df.filter("id % 3 <> 0").select("k", "t", F.col("id").alias("rid"))
    a, b = left.collect(), right.collect()
    for forward in (False, True):
        want = {}
        for r in a:
            hits = [(x.t, x.rid) for x in b if x.k == r.k and (x.t >= r["at"] if forward else x.t <= r["at"])]
            want[r.id] = (min(hits)[0] if forward else max(hits)[0]) if hits else None
        for limit in (10**6, 15):
            got = ordered.as_of(left, right, ["k"], "at", "t", ["rid"], forward, limit)
            assert {r.id: (r.match.t if r.match else None) for r in got.collect()} == want


def test_exact_quantiles_by_bracket(spark):
    draw = random.Random(5)
    data = [("a" if draw.random() < 0.8 else "b", float(draw.choice([0, 0, 1, 7]) or draw.random() * 50)) for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, x double")
    qs = {"q50": 0.5, "q90": 0.9}
    plain = ordered.exact_quantiles(df, ["g"], "x", qs)
    bracket = ordered.exact_quantiles(df, ["g"], "x", qs, accuracy=200)
    for p, b in zip(rows(plain, "g"), rows(bracket, "g")):
        assert p[0] == b[0] and abs(p[1] - b[1]) < 1e-9 and abs(p[2] - b[2]) < 1e-9
    whole = ordered.exact_quantiles(df, [], "x", qs)
    assert abs(whole.first().q90 - ordered.exact_quantiles(df, [], "x", qs).first().q90) < 1e-9


def test_exact_quantiles_of_every_size(spark):
    draw = random.Random(11)
    data = [(n, draw.choice([0.0, 1.0, 3.0, float(draw.randint(-9, 9)), draw.random()])) for n in range(1, 51) for _ in range(n)]
    data += [(None, 4.0), (None, 8.0), (99, None)]
    df = spark.createDataFrame(data, "g int, x double")
    qs = {"q00": 0.0, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    for accuracy in (10_000, 20, 7):
        got = {r.g: r for r in ordered.exact_quantiles(df, ["g"], "x", qs, accuracy).collect()}
        assert set(got) == {None, *range(1, 51)}
        for g, row in got.items():
            values = [x for k, x in data if k == g]
            for name, q in qs.items():
                assert abs(row[name] - np.quantile(values, q)) < 1e-12, (g, name, accuracy)


def test_exact_quantiles_after_a_missed_bracket(spark, monkeypatch):
    draw = random.Random(13)
    values = [draw.choice([0.0, 1e-300, 1e300, -1e308, 1e308, draw.random()]) for _ in range(900)]
    df = spark.createDataFrame([(k % 2, x) for k, x in enumerate(values)], "g int, x double")
    sketched = ordered._sketched

    def wrong(*arguments):
        return sketched(*arguments).withColumns({"low": F.lit(0.9), "high": F.lit(0.95)})

    want = ordered.exact_quantiles(df, ["g"], "x", {"a": 0.3, "b": 0.77})
    whole = ordered.exact_quantiles(df, [], "x", {"a": 0.3, "b": 0.77})
    monkeypatch.setattr(ordered, "_sketched", wrong)
    assert rows(ordered.exact_quantiles(df, ["g"], "x", {"a": 0.3, "b": 0.77}), "g") == rows(want, "g")
    assert rows(ordered.exact_quantiles(df, [], "x", {"a": 0.3, "b": 0.77})) == rows(whole)
    for row in rows(want, "g"):
        own = [x for k, x in enumerate(values) if k % 2 == row[0]]
        assert np.allclose(row[1:], np.quantile(own, [0.3, 0.77]))


def test_tie_ranks_match_window(spark):
    draw = random.Random(7)
    df = spark.createDataFrame([(draw.randint(0, 60) / 1000, draw.randint(0, 1)) for _ in range(500)], "probability double, label int")
    w = Window.orderBy("probability")
    want = df.select(
        F.col("probability"), (F.rank().over(w) + (F.count("*").over(Window.partitionBy("probability")) - 1) / 2).alias("r")
    ).distinct()
    got = tie_ranks(df, []).select("score", "average_rank")
    assert rows(got, "score") == rows(want, "probability")


def test_last_captures_of_a_cut_key(spark):
    df = skewed(spark)
    plain = intervals.last_captures(df, ["k"], ["v"], 4, "t", ["id"])
    cut = intervals.last_captures(df, ["k"], ["v"], 4, "t", ["id"], hot_rows=5)
    assert rows(plain, "k", "recency") == rows(cut.select(plain.columns), "k", "recency")


def test_containment_counts_against_pairs(spark):
    df = skewed(spark)
    spans = ordered.with_previous(df, ["k"], "t", [], ["id"]).filter("prev is not null").select("k", "id", F.col("prev.t").alias("a"), F.col("t").alias("b"))
    got = intervals.containment_counts(spans, df, ["k"], "a", "b", "t", span_seconds=5000)
    pts = df.collect()
    for r in got.collect():
        assert r.points_in_window == sum(p.k == r.k and r.a < p.t <= r.b for p in pts)

import random
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm import toxicity as tox

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("toxic", T.StringType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("text", T.StringType())])
PLAIN = "the quiet river ran under an old bridge while people walked home again and talked about bread".split()


def corpus():
    rnd = random.Random(2)
    docs, labels = [], []
    for k in range(600):
        words = [rnd.choice(PLAIN) for _ in range(rnd.randint(5, 60))]
        bad = k % 6 == 0
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(["grobnik", "snarvel"])
        docs.append((k, " ".join(words), "1"))
        labels.append((k, int(bad), "x"))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    table = spark.createDataFrame(docs, DOCS)
    return table, tox.train(table, spark.createDataFrame(labels + [(None, 1, ""), (1, None, ""), (3, 7, "")], LABELS))


def scores(spark, model, texts):
    df = spark.createDataFrame([(k, t, "") for k, t in enumerate(texts)], DOCS)
    return [r.s for r in df.select("doc_id", tox.score(model, F.col("text")).alias("s")).orderBy("doc_id").collect()]


def test_held_out_accuracy(spark, fitted):
    table, model = fitted
    rows = table.select("doc_id", tox.held_out().alias("h"), tox.score(model, F.col("text")).alias("s")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.h]
    assert len(held) > 100 and all((r.s >= 0.3) == (r.doc_id % 6 == 0) for r in held)


def test_disguised_words_are_found_and_clean_ones_stay(spark, fitted):
    _, model = fitted
    disguised = ["gr0bnik", "gro8nik", "s n a r v e l", "s.n.a.r.v.e.l", "sn@rvel", "$narv3l", "grooooobnik", "GR0BN1K", "snarvellll!"]
    got = scores(spark, model, [f"the old {w} bridge" for w in disguised])
    assert all(s >= 0.3 for s in got), list(zip(disguised, got, strict=True))
    clean = ["", None, " ", "the river", "room 101 and b2b", "a b c d", "e.g. the old bridge", "7" * 5000, "brrrrr the river ran " * 2000]
    assert all(s < 0.3 for s in scores(spark, model, clean))


def test_long_phrases_and_quoted_tokens(spark, fitted):
    _, model = fitted
    spaced = " ".join("theoldgrobnikwalkedhomeagain")
    wide = "  ".join("theoldgrobnikranhome")
    cases = ["gr0bnik?", '"gr0bnik"', "gr0bnik)", "gr0bnik:", "(gr0bnik)", "'gr0bnik';", "gr" + "o" * 60 + "bnik", "g" * 500 + "r0bnik"]
    cases += ["t h e g r o b n i k", "t-h-e-g-r-o-b-n-i-k", '"s n a r v e l"', spaced, wide]
    got = scores(spark, model, [f"the old {w} bridge" for w in cases])
    assert all(s >= 0.3 for s in got), list(zip(cases, got, strict=True))
    clean = ["a1" * 20_000, "a!" + "!" * 50_000 + "é", "*" * 50_000 + "é", "*" * 50_000, "!" * 50_000, " ".join("theoldbridgewalkedhomeagain"), "x " * 20_000, '"b2b"? (room 101):']
    assert all(s < 0.3 for s in scores(spark, model, clean))


def test_lattice_against_all_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    costs = rng.uniform(0.1, 6, (27, 27, 27)).astype(np.float32)
    for token in ("g0o1", "aaab3", "b@11", "x.y0"):
        best = []
        for choice in itertools.product(*tox._steps(token)):
            text, cost = "".join(c for c, _ in choice), sum(c for _, c in choice)
            x = y = 0
            for z in [ord(c) - 96 for c in text] + [0]:
                cost += float(costs[x, y, z])
                x, y = y, z
            best.append((cost, text))
        best = [t for _, t in sorted(best) if len(t) > 2]
        got = tox.decode(token, costs, paths=50, slack=1e9)
        assert got[:3] == list(dict.fromkeys(best))[:3]


def test_without_labels_nothing_is_toxic(spark):
    docs = spark.createDataFrame(corpus()[0][:5], DOCS)
    model = tox.train(docs, spark.createDataFrame([], LABELS))
    assert scores(spark, model, ["grobnik", None]) == [0.0, 0.0]
    empty = spark.createDataFrame([], DOCS)
    assert tox.train(empty, spark.createDataFrame([], LABELS)).fit is None


def test_sample_is_bounded_at_any_size(spark):
    known = spark.range(3_000_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    assert tox.bounded_sample(known, 2).count() == 2
    assert tox.bounded_sample(known.filter("doc_id < 9"), 20).count() == 9
    few = tox.bounded_sample(known.filter("doc_id < 900"), 50).collect()
    assert few == tox.bounded_sample(known.filter("doc_id < 900").repartition(7), 50).collect() and len(few) == 50

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from tallyscope.llm.importance import buckets_of, gain_planes, resample, sliced_weights

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())]
)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [zlib.crc32(w.encode()) % buckets for w in words]


def brute(docs, target, percent, least, buckets):
    own = [features(t, buckets) for _, t in docs]
    s, t = Counter(b for f in own for b in f), Counter(b for x in target for b in features(x, buckets))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for (doc, _), f in zip(docs, own, strict=True):
        weight, score = sum(map(gain, f)), None
        if doc is not None:
            h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(f), weight, score, None])
    able = sorted((r for r in rows if r[1] >= least and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for k, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = k + 1
    return sorted(map(tuple, rows), key=repr)


def corpus():
    rnd = random.Random(1)
    pool = [f"w{k}" for k in range(60)] + ["École", "ÜBER", "don't", "x_y", "12,5"]
    docs = [(k, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 90)))) for k in range(200)]
    docs += [(1000 + k, docs[5][1]) for k in range(90)]
    docs += [(2000, None), (2001, ""), (2002, " .,\n"), (2003, "w1 " * 70_000), (None, docs[7][1]), docs[3], docs[3]]
    return docs, [docs[5][1], "w3 w3 w4 new words", None, ""]


def test_rows_equal_brute_force(spark):
    docs, target = corpus()
    wide = spark.createDataFrame([(d, t, "q") for d, t in docs], SCHEMA).repartition(4)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for buckets, percent, least in ((10_000, 10, 20), (70, 45, 3)):
        got = resample(wide, goal, percent, least, buckets=buckets)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target, percent, least, buckets)


def test_planes_give_exact_sums():
    rnd = np.random.default_rng(6)
    for buckets, high in ((64, 3), (100, 900), (10_000, 20_000)):
        gain = rnd.integers(-high, high, buckets)
        owners, found = rnd.integers(0, 9, 5000), (rnd.random(5000) ** 4 * buckets).astype(int)
        want = np.zeros(9, np.int64)
        np.add.at(want, owners, gain[found])
        assert (sliced_weights(owners, found, 9, *gain_planes(gain), buckets) == want).all()
    assert (sliced_weights(np.zeros(4, int), np.zeros(4, int), 2, *gain_planes(np.zeros(8, int)), 8) == 0).all()


def test_runs_of_words_are_features():
    assert len(buckets_of(b"a b c", 10_000, 2)) == 5
    assert buckets_of(b"A-b", 1 << 32, 2)[2] == zlib.crc32(b"a b")


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resample(none, none).collect() == []
    one = spark.createDataFrame([(1, "a " * 30, None)], SCHEMA)
    assert [(r.n_features, r["rank"]) for r in resample(one, none, percent=100).collect()] == [(30, 1)]

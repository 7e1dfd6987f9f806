import random
import re

import numpy as np
from pyspark.sql import types as T

from tallyscope.llm import minhash_dedup
from tallyscope.llm.minhash_dedup import near_duplicates

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("bucket", T.StringType())])
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * len(sets[i] | sets[j]):
                    top[root(i)] = root(j)
    out = []
    for k, (doc, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if root(j) == root(k)]
        name = None if doc is None else min(x for x in same if x is not None)
        out.append((doc, len(sets[k]), name, doc is None or doc == name))
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(rnd.randint(40, 120))]
        for _ in range(8):
            text = list(base)
            for _ in range(rnd.randint(0, 4)):
                text[rnd.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rnd.shuffle(rows)
    rows += ["", None, "  \t\n", "one two", "One TWO", "one two three", rows[0], rows[0].upper(), "é É ü x y z", "x " * 3000]
    out = [(k * 3 % 1000, t) for k, t in enumerate(rows)]
    return out + [(None, rows[1]), out[4], out[4]]


def result(spark, rows):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr)


def test_classes_equal_brute_force(spark):
    rows = corpus()
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert result(spark, []) == []


def crowd(centres, copies, seed):
    """Near copies around several centres that themselves resemble each other."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(90)]
    texts = []
    for _ in range(centres):
        centre = list(base)
        for k in rnd.sample(range(90), 3):
            centre[k] = word()
        for _ in range(copies):
            text = list(centre)
            for k in rnd.sample(range(90), rnd.randint(0, 3)):
                text[k] = word()
            texts.append(" ".join(text))
    rnd.shuffle(texts)
    return [(k, t) for k, t in enumerate(texts)]


def test_crowd_around_several_centres(spark, monkeypatch):
    rows = crowd(6, 30, 3) + [(1000 + k, t) for k, t in crowd(3, 20, 4)]
    want = brute(rows)
    assert len({r[2] for r in want}) > 3
    assert result(spark, rows) == want
    for block, size in ((16, 8_000_000), (512, 5_000)):
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", size)
        monkeypatch.setattr(minhash_dedup, "PIVOT", block)
        assert result(spark, rows) == want


def test_blocks_return_forests():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 9000, rnd.integers(1, 300)).astype(np.uint64)) for _ in range(40)]
    both = minhash_dedup._common(sets[:15], sets[15:])
    assert both.tolist() == [[len(np.intersect1d(a, b)) for b in sets[15:]] for a in sets[:15]]
    names = np.arange(30)
    every = np.array([(a, b) for a in range(30) for b in range(a)]).T
    assert len(minhash_dedup._forest(names, [tuple(every)])) == 29
    assert len(minhash_dedup._forest(names // 10, [tuple(every)])) == 2

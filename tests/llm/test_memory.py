"""What Python workers and rounds of components hold follows their bounds, not the table."""

import tracemalloc

import numpy as np
import pandas as pd

from tallyscope.llm import minhash_dedup, shared, toxicity
from tallyscope.llm.words import STRETCH, Words
from tallyscope.operators.components import gathered, stars


def peak(work, *args):
    tracemalloc.start()
    out = work(*args)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_words_are_hashed_in_stretches():
    words = [f"Word{k * 7}".encode() for k in range(250_000)] + [b"x" * 70_000, b"y" * (STRETCH + 3), b"z" * 140_000, b"end"]
    text = b"  " + b" ".join(words) + b" \t" * STRETCH + b"last"
    got, most = peak(Words, [text, b"", b" ", b"end"])
    assert most < 10 * len(text)
    picked = [0, 1, 12_345, 249_999, *range(250_000, 250_004)]
    assert [got.word(k) for k in picked] == [words[k] for k in picked]
    alone = {w: int(Words([w]).hashes[0]) for w in [words[k] for k in picked] + [b"last"]}
    assert [int(got.hashes[k]) for k in picked] == [alone[words[k]] for k in picked]
    assert len(set(alone.values())) == len(alone)
    assert [int(h) for h in got.hashes[-2:]] == [alone[b"last"], alone[b"end"]]


def test_features_of_words_in_little_memory():
    text = b" ".join(b"feature%d" % k for k in range(60_000))
    (owner, key), most = peak(toxicity.feature_hashes, [text])
    assert len(owner) == len(key) == 4 * 60_000 and most < 20 * len(text)
    begins = toxicity.feature_hashes([b"feature1"])[1]
    assert set(begins.tolist()) <= set(key.tolist()) and len(set(begins.tolist())) == 4


def test_batches_are_bounded_by_bytes(spark):
    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.unset(name)
        minhash_dedup.near_duplicates(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))
        docs = spark.range(3000, numPartitions=1).selectExpr("repeat('text ', 1000) AS text")
        sizes = docs.mapInPandas(lambda fs: (pd.DataFrame({"n": [int(f["text"].str.len().sum())]}) for f in fs), "n long").collect()
        assert sum(r.n for r in sizes) == 15_000_000 and max(r.n for r in sizes) <= shared.BATCH_BYTES + 5_000
        spark.conf.set(name, "1000000")
        shared.small_batches(spark)
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.set(name, before)


def test_rounds_of_small_tables_have_few_tasks(spark):
    edges = spark.range(1, 3000, numPartitions=90).selectExpr("id AS u", "id - 1 AS v")
    cores = spark.sparkContext.defaultParallelism
    assert gathered(edges).rdd.getNumPartitions() == cores
    found = stars(edges, 60)
    assert found.rdd.getNumPartitions() <= cores
    assert np.array_equal(sorted(r.u for r in found.filter("v = 0").collect()), np.arange(1, 3000))

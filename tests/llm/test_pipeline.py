"""The pipeline on a small table: each stage against what its predecessor wrote."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline as pipeline
from tallyscope.llm import pii

from .test_minhash_dedup import brute as classes
from .test_pii import brute as spans
from .test_substring_dedup import brute as cut
from .test_toxicity import PLAIN, corpus

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("kept_text", T.StringType()),
    ]
)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, labels = corpus()
    passage = " ".join(f"{w}{k}" for k, w in enumerate(PLAIN + PLAIN))
    texts = [(k, t) for k, t, _ in docs]
    texts += [(1000 + k, f"intro {k} {'abcdefg'[k]} {passage} mail zed{k}@corp.example or +1 (202) 555-010{k} end") for k in range(6)]
    texts += [(2000, texts[0][1]), (2001, texts[1][1]), (2002, ""), (2003, None), (2004, "short"), (None, "no id a@b.cc")]
    rows = [(k, t, "en" if k else None, "s", None, "clash") for k, t in texts]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, x) for k, x, _ in labels], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = [spark.read.parquet(f"{folder}/documents.parquet")]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], folder).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return folder, out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_and_toxic_documents(stages):
    _, out = stages
    assert all(tuple(df.columns) == pipeline.COLUMNS for df in out[1:-1])
    left = {r[0] for r in pairs(out[1])}
    assert not left & {k for k in range(600) if k % 6 == 0} and {1, 2, 1000, 2002, 2003, None} <= left


def test_one_of_each_class_stays(stages):
    _, out = stages
    want = {d for d, _, _, kept in classes(pairs(out[1])) if kept}
    assert {r[0] for r in pairs(out[2])} == want and 2001 not in want


def test_repeated_windows_go(stages):
    _, out = stages
    want = cut(pairs(out[2]))
    got = dict(pairs(out[3]))
    assert {k: want[k][2] for k in want} == {k: v for k, v in got.items() if k is not None}
    assert got[None] == "no id a@b.cc"


def test_personal_data_is_hidden(stages):
    _, out = stages
    before, after = dict(pairs(out[3])), dict(pairs(out[4]))
    assert set(before) == set(after)
    for key, text in before.items():
        if not any(spans(text).values()):
            assert after[key] == (text or "")
        assert not any(spans(after[key] or "").values())
        assert len(re.findall(r"\[EMAIL\]", after[key] or "")) == len(spans(text)["email"])
    assert pii.KINDS == ("email", "ip", "card", "phone")


def test_packing_covers_all_and_run_gives_the_same(spark, stages):
    folder, out = stages
    last = out[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in last} == {k for k, _ in pairs(out[4])} and all(r.n == r.t for r in last)
    whole = pipeline.run(spark, folder).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert sorted(map(tuple, whole), key=repr) == sorted(map(tuple, last), key=repr)
    assert pipeline.ORACLE_SQL is None and 4 <= len(pipeline.STAGES) <= 5

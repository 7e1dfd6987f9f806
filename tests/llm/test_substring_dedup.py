import random
import re

import numpy as np
from pyspark.sql import types as T

from tallyscope.llm import substring_dedup as module
from tallyscope.llm.substring_dedup import substring_dedup

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("words", T.StringType())])


def brute(rows):
    """Rows sharing a doc_id aside, this is the definition."""
    seen, out = set(), {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        out[doc] = (len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def corpus():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(3))
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "a " * 500, "x y " * 30 + "z", " ".join(passage)]
    for _ in range(40):
        words = [word() for _ in range(rnd.randint(1, 60))]
        lo = rnd.randint(0, 30)
        words[5:5] = passage[lo : lo + rnd.randint(10, 30)]
        texts.append(rnd.choice([" ", "\n", "\t "]).join(words))
    texts += [texts[8], " " + texts[8] + "\n", "short copy", "short copy", "w" * 100_000 + " " + " ".join(passage[:25])]
    rnd.shuffle(texts)
    return [(k * 7 % 1000, t) for k, t in enumerate(texts)]


def result(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in substring_dedup(df, **more).collect()]


def test_equals_the_definition_at_either_prefix_length(spark):
    rows = corpus()
    want = brute(rows)
    for heavy in (50_000, 1):
        got = {r[0]: r for r in result(spark, rows, heavy=heavy)}
        assert {k: tuple(v[1:4]) for k, v in got.items()} == want
    for _, n, removed, _, spans in got.values():
        assert sum(b - a for a, b in spans) == removed and all(0 <= a < b <= n for a, b in spans)


def test_rows_without_an_id_repeated_rows_and_shared_ids(spark):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(1, long), (1, long), (None, long), (2, long), (3, "one"), (3, "two " * 50)]
    got = sorted((r[:3] for r in result(spark, rows)), key=repr)
    # Of the two texts under doc_id 3 one takes part, and only its own repeats go.
    assert got[:3] == [(1, 30, 0), (1, 30, 0), (2, 30, 30)]
    assert (None, 30, 0) in got and (3, 1, 0) in got and len(got) == 6


def test_empty_table(spark):
    assert result(spark, []) == []


def test_long_runs_are_several(monkeypatch):
    monkeypatch.setattr(module, "RUN_LIMIT", 7)
    doc = np.array([1] * 30 + [2] * 7 + [2] * 3)
    pos = np.array([*range(5, 35), *range(7), *range(20, 23)], np.int32)
    runs = module._runs(doc, pos)
    got = [(d, (r >> 24) + k) for d, r in zip(runs.doc_id, runs.run, strict=True) for k in range(r & 0xFFFFFF)]
    assert got == list(zip(doc.tolist(), pos.tolist(), strict=True)) and len(runs) == 5 + 1 + 1

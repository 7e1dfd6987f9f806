import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tallyscope.llm.packing import Encoder, default_tokenizer, pack

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("length", T.StringType())]
)
TEXTS = ["", None, "Hello  World", "é́ ÉCOLE x ß's don't 12,5", "<|endoftext|> a", "ab " * 900, "q" * 5000, "\n\t"] + [
    " ".join(f"w{k}x{j * j}" for j in range(k * 7 % 50)) for k in range(120)
]


@pytest.mark.parametrize("length,room", [(64, 4), (2048, 64)])
def test_every_id_once_and_windows_full(spark, length, room):
    rows = [(k, t, "z") for k, t in enumerate(TEXTS)] + [(None, "tail", None), (0, "", "z")]
    got = pack(spark.createDataFrame(rows, SCHEMA).repartition(5), default_tokenizer(), length, room).toPandas()
    tokenizer = Tokenizer.from_file(default_tokenizer())
    want = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in enumerate(TEXTS)}
    for doc, ids in want.items():
        own = got[(got.doc_id == doc) & (got["length"] > 0)].sort_values("start")
        if doc == 0:
            assert len(own) == 2
            continue
        assert np.concatenate([np.frombuffer(x, "<u4") for x in own.ids]).tolist() == ids
        assert own.start.tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
        assert set(own.doc_tokens) == {len(ids)}
    assert got.doc_id.isna().sum() == 1
    assert [zlib.crc32(x) for x in got.ids] == got.ids_crc32.tolist()
    sizes = []
    for _, window in got.sort_values("offset").groupby("sequence_id"):
        assert window.offset.tolist() == [0, *window["length"].cumsum().tolist()[:-1]]
        sizes.append(window["length"].sum())
    assert max(sizes) <= length
    assert sum(s < length - 16 for s in sizes) <= 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), default_tokenizer()).collect() == []


def test_known_words_stay_small():
    encoder = Encoder(default_tokenizer())
    texts = [" ".join(f"{k}word{k * 7919 % 100_003}" for k in range(lo, lo + 20_000)).encode() for lo in range(0, 100_000, 20_000)]
    tracemalloc.start()
    first = [encoder([t])[0] for t in texts]
    held = tracemalloc.get_traced_memory()[0] - sum(map(len, first))
    tracemalloc.stop()
    assert held < 100 * 100_000
    want = [encoder.tokenizer.encode(t.decode(), add_special_tokens=False).ids + [1] for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in first] == want
    # Known words, and words known before they were forgotten, have the same ids.
    assert encoder(texts[::-1]) == first[::-1]
    encoder.forget()
    assert encoder(texts) == first

import itertools
import random
import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import types as T

from tallyscope.llm import sentencepiece_fst as fst

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType())])
MODEL = fst.default_model()
PARTS = ["a", "b", "e", "n", "th", "in", " ", "  ", "   ", "\n", "é", "😀", "ß", "the", "1", "0", ".", "\t", "▁", "梦", "un", " " * 17, "́", "\x00"]


def texts():
    rnd = random.Random(7)
    out = ["", None, " ", "Hello  world\n\nfoo   bar é😀", "x" * 5000, " lead", "trail ", "<s> </s> <unk> <0x0A>"]
    return out + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(600)] + ["word " * 4000]


def test_ids_equal_the_library_and_texts_come_back(spark):
    rows = [(k, t, "x") for k, t in enumerate(texts())] + [(None, "again", "x"), (3, texts()[3], "x")]
    back = fst.decode(fst.encode(spark.createDataFrame(rows, SCHEMA), MODEL), MODEL).collect()
    assert len(back) == len(rows)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for r in back:
        text = "again" if r.doc_id is None else texts()[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<i4").tolist() == library.encode(text), repr(text[:80])
        assert r.n_ids == len(r.ids) // 4 and r.text == text.replace("▁", " ")


def test_path_is_the_only_one_of_finite_weight():
    model = fst.transducer(MODEL)
    rnd = random.Random(1)
    for _ in range(300):
        unit = "▁" + "".join(rnd.choice("aeinrstho") for _ in range(rnd.randint(1, 9)))
        paths = [[]]
        complete = []
        while paths:
            path = paths.pop()
            at = sum(map(len, path))
            if at == len(unit):
                complete.append(path)
                continue
            for end in range(at + 1, len(unit) + 1):
                arc = unit[at:end]
                if arc in model.ids and model.edge(arc, 0) is not None and (not path or model.follows(path[-1], arc)):
                    paths.append([*path, arc])
        assert complete == [model.shortest_path(unit)] == [model.merged(unit)]


def test_empty_table(spark):
    assert fst.decode(fst.encode(spark.createDataFrame([], SCHEMA), MODEL), MODEL).collect() == []


def field(number, value):
    """A protocol buffer field: bytes, a float or a small integer."""
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def unigram(fallback, squeeze=False, kind=1):
    """A model with random scores over short strings, as a file of the library has it."""
    rnd = random.Random(3)
    words = {"".join(p) for n in (1, 2, 3) for p in itertools.product("ab\u2581", repeat=n)}
    words = sorted(w for w in words if "\u2581" not in w[1:] and rnd.random() < 0.8 or len(w) == 1)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(w, -rnd.uniform(1, 9) * len(w) ** 0.5, 1) for w in words]
    body = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in pieces)
    trainer = field(3, kind) + (field(35, 1) if fallback else b"")
    normaliser = field(1, b"identity") + field(3, 1) + field(4, int(squeeze)) + field(5, 1)
    return body + field(2, trainer) + field(3, normaliser)


def cheapest(model, unit):
    """The smallest weight over all paths, listed one by one."""
    best = float("inf")
    stack = [(0, 0.0)]
    while stack:
        at, weight = stack.pop()
        if at == len(unit):
            best = min(best, weight)
        for end in range(at + 1, len(unit) + 1):
            if unit[at:end] in model.ids:
                stack.append((end, weight - model.scores[unit[at:end]]))
            elif end == at + 1:
                stack.append((end, weight - min(model.scores.values()) + 10))
    return best


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_unigram_models_take_the_cheapest_of_all_paths(fallback, squeeze):
    data = unigram(fallback, squeeze)
    model = fst.Transducer(data)
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    rnd = random.Random(4)
    texts = ["", " ", "a  b ", "éé", "é éé a", "ab" * 200, "\t\té"] + ["".join(rnd.choice("aab  éz😀\n\t") for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    batch = model.encode_batch([t.encode() for t in texts])
    for text, ids in zip(texts, batch, strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text) == np.frombuffer(model.encode(text), "<i4").tolist(), repr(text)
    for text in texts[7:60]:
        unit = model.normalise(text)[:9]
        for ids in (model.compose([unit])[0], None):
            parts = model.shortest_path(unit) if ids is None else None
            if parts is None and not fallback:
                parts, at = [], 0
                for k in ids:
                    size = 1 if k == model.unknown else len(model.pieces[k][0])
                    parts.append(unit[at : at + size])
                    at += size
            if parts is not None:
                weight = sum(-model.scores.get(p, min(model.scores.values()) - 10) for p in parts)
                assert abs(weight - cheapest(model, unit)) < 1e-3


def test_verdicts_on_neighbours_by_arrays_equal_those_by_text():
    model = fst.transducer(MODEL)
    rnd = random.Random(9)
    names = list(model.arcs)
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(3000)]
    # Halves of pieces are the pairs that merging is likely to join.
    pairs += [(p[:k], p[k:]) for p in rnd.sample(names, 2000) for k in range(1, len(p)) if p[:k] in model.arcs and p[k:] in model.arcs]
    x, y = (np.asarray([model.arcs[p[side]] for p in pairs]) for side in (0, 1))
    for _ in range(2):
        assert model.follow_many(x, y).tolist() == [model.merged(a + b) == [a, b] for a, b in pairs]


def test_overwritten_slots_and_long_units_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(fst, "SLOTS", 4)
    monkeypatch.setattr(fst, "TOKEN_SLOTS", 8)
    monkeypatch.setattr(fst, "CHUNK", 500)
    with open(MODEL, "rb") as f:
        model = fst.Transducer(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    some = [t or "" for t in texts()][:300] + ["pneumono" * size for size in (7, 8, 9, 4000)] + ["é梦😀" * 50]
    for text, ids in zip(some * 2, model.encode_batch([t.encode() for t in some] * 2), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(text), repr(text[:80])


def test_models_of_other_kinds_are_refused():
    with pytest.raises(ValueError, match="neither"):
        fst.Transducer(unigram(True, kind=3))


def test_round_trip_equals_the_two_steps(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts())], SCHEMA)
    two = fst.decode(fst.encode(df, MODEL), MODEL).collect()
    assert sorted(fst.round_trip(df, MODEL).collect()) == sorted(two)

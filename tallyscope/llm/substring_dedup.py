"""Substring deduplication by fingerprints of 20-word windows.

This stands in for the dealt prefix-partitioned suffix trees: there are no trees, no sorted suffixes and
no internal nodes (see the README). A window is ``WINDOW`` consecutive words, compared by two 64-bit hashes
of its halves. Its anchor is the lightest ``PREFIX``-word run inside it, a choice that depends on the
window's words alone, so equal windows have equal anchors at equal offsets.

1. Anchors are counted over all texts. A window whose anchor occurs once can't repeat and goes.
2. The remaining windows are dealt to parts by their anchor's hash; those of anchors above ``HEAVY``
   occurrences by the hash of all ``WINDOW`` words. The number of parts follows the bytes of text.
3. Each part sorts its windows by their hashes. Of equal windows the earliest stays, the others go, and
   neighbouring windows join into maximal spans.

Windows travel as packed arrays, one row per task and part. A batch compares its own windows first and
sends the earliest of each for comparison; the others go along as known repeats. All occurrences of an
anchor, and the known repeats of a window, meet in one part, so the hottest passage bounds it.
Texts with equal words are collapsed before all that: only the first is searched.

Defined cases: null or empty text has no words, keeps nothing and its digest is that of the empty
string. A row without doc_id is returned unchanged and hides nothing. Of different texts under one
doc_id the one with the smallest text hash takes part and the others come back unchanged; exact
repeats of a row get the same result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .shared import cut_lineage, small_batches
from .words import Words, chunks, encode, grams

WINDOW = 20
PREFIX = 5
HEAVY = 50_000
GROUP_BYTES = 8_000_000
SEED = 11

_PACKED = "part int, kind int, a binary, b binary, doc binary, pos binary"


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window start, its text, anchor position, anchor hash) of every window inside one text."""
    texts = words.text_of_word()
    count = len(texts) - WINDOW + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    value = grams(words.hashes, PREFIX, SEED)
    best, place = value, np.arange(len(value))
    reach, span = WINDOW - PREFIX + 1, 1

    def lighter(step: int, length: int):
        a, b, pa, pb = best[:length], best[step : step + length], place[:length], place[step : step + length]
        take = b < a
        return np.where(take, b, a), np.where(take, pb, pa)

    while span * 2 <= reach:
        best, place = lighter(span, len(best) - span)
        span *= 2
    if span < reach:
        best, place = lighter(reach - span, len(best) - (reach - span))
    start = np.flatnonzero(texts[:count] == texts[WINDOW - 1 :])
    return start, texts[start], place[start], best[start]


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)


def _packed(part: np.ndarray, kind: int, columns: list[np.ndarray]) -> pd.DataFrame:
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    rows = []
    for piece in np.split(order, cuts) if len(order) else []:
        rows.append([int(part[piece[0]]), kind, *(c[piece].tobytes() if len(c) else b"" for c in columns)])
    return pd.DataFrame(rows, columns=["part", "kind", "a", "b", "doc", "pos"])


def _batches(frames, *extra):
    for frame in frames:
        texts = [encode(t) for t in frame["text"]]
        ids = frame["doc_id"].to_numpy(np.int64)
        for lo, hi in chunks(texts):
            yield Words(texts[lo:hi]), ids[lo:hi], *(frame[e].iloc[lo:hi] for e in extra)


def _send_anchors(parts: int):
    def run(frames):
        for words, ids in _batches(frames):
            start, text, place, key = _anchors(words)
            place, first = np.unique(place, return_index=True)
            key, text = key[first], text[first]
            position = (place - words.offsets[text]).astype(np.int32)
            none = np.zeros(0)
            yield _packed(_parts(key, parts), 0, [key, none, ids[text], position])

    return run


def _repeated_anchors(heavy: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        key = np.frombuffer(b"".join(frame["a"]), np.uint64)
        doc = np.frombuffer(b"".join(frame["doc"]), np.int64)
        pos = np.frombuffer(b"".join(frame["pos"]), np.int32)
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        count = count[back]
        hit = count > 1
        coded = pos[hit].astype(np.int64) * 2 + (count[hit] > heavy)
        return pd.DataFrame({"doc_id": doc[hit], "anchor": coded})

    return run


def _later_windows(a: np.ndarray, b: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Of windows in the order of their hashes, those that are not the earliest of equal ones."""
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
    return (doc != doc[first]) | (pos != pos[first])


def _send_windows(parts: int):
    """Candidate windows of each text, one of equal ones per batch; the others are known repeats."""

    def run(frames):
        for words, ids, hits in _batches(frames, "anchors"):
            start, text, place, key = _anchors(words)
            base = words.offsets[:-1]
            coded = [np.asarray(h, np.int64) + 2 * b for h, b in zip(hits, base, strict=True)]
            coded = np.concatenate(coded) if coded else np.zeros(0, np.int64)
            flag = np.zeros(len(words.hashes) + 1, np.int8)
            flag[coded >> 1] = 1 + (coded & 1)
            take = flag[place] > 0
            start, text, place, key = start[take], text[take], place[take], key[take]
            half = WINDOW // 2
            halves = [grams(words.hashes, half, SEED + 1), grams(words.hashes, WINDOW - half, SEED + 2)]
            a, b = halves[0][start], halves[1][start + half]
            doc, pos = ids[text], (start - base[text]).astype(np.int32)
            order = np.lexsort((pos, doc, b, a))
            repeat = np.zeros(len(order), bool)
            repeat[order] = _later_windows(a[order], b[order], doc[order], pos[order])
            path = np.where(flag[place] == 2, a ^ (b >> np.uint64(1)), key)
            part = _parts(path, parts)
            none = np.zeros(0)
            yield _packed(part[~repeat], 0, [a[~repeat], b[~repeat], doc[~repeat], pos[~repeat]])
            yield _packed(part[repeat], 1, [none, none, doc[repeat], pos[repeat]])

    return run


RUN_LIMIT = (1 << 24) - 1


def _runs(doc: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
    order = np.lexsort((pos, doc))
    doc, pos = doc[order], pos[order].astype(np.int64)
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(fresh)
    length = np.diff(np.append(first, len(doc)))
    # A run has 24 bits for its length: a longer one is several.
    pieces = -(-length // RUN_LIMIT)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(pos[first], pieces) + within * RUN_LIMIT
    left = np.minimum(np.repeat(length, pieces) - within * RUN_LIMIT, RUN_LIMIT)
    return pd.DataFrame({"doc_id": np.repeat(doc[first], pieces), "run": start << 24 | left})


def _repeated(frame: pd.DataFrame) -> pd.DataFrame:
    """Windows in the order of their hashes; all but the earliest of equal ones repeat it."""
    suffixes, known = frame[frame["kind"] == 0], frame[frame["kind"] == 1]
    a = np.frombuffer(b"".join(suffixes["a"]), np.uint64)
    b = np.frombuffer(b"".join(suffixes["b"]), np.uint64)
    doc = np.frombuffer(b"".join(suffixes["doc"]), np.int64)
    pos = np.frombuffer(b"".join(suffixes["pos"]), np.int32)
    order = np.lexsort((pos, doc, b, a))
    a, b, doc, pos = a[order], b[order], doc[order], pos[order]
    later = _later_windows(a, b, doc, pos)
    more_doc = np.frombuffer(b"".join(known["doc"]), np.int64)
    more_pos = np.frombuffer(b"".join(known["pos"]), np.int32)
    return _runs(np.concatenate([doc[later], more_doc]), np.concatenate([pos[later], more_pos]))


def _cut(frames):
    for frame in frames:
        carried = [c for c in frame.columns if c.startswith("_carried_")]
        texts = [encode(t) for t in frame["text"]]
        out = []
        for lo, hi in chunks(texts):
            words = Words(texts[lo:hi])
            part = frame.iloc[lo:hi]
            for k, (doc_id, runs, role) in enumerate(zip(part["doc_id"], part["runs"], part["role"], strict=True)):
                w0, w1 = words.offsets[k], words.offsets[k + 1]
                n = int(w1 - w0)
                gone = np.zeros(n + 1, np.int64)
                if role == 1 and n >= WINDOW:
                    gone[0], gone[n] = 1, -1
                elif role is None or pd.isna(role):
                    runs = np.asarray(runs if runs is not None else [], np.int64)
                    at, length = runs >> 24, runs & ((1 << 24) - 1)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, np.minimum(at + length + WINDOW - 1, n), -1)
                gone = gone.cumsum()[:n] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                kept = b" ".join(words.word(w0 + i) for i in np.flatnonzero(~gone)) if n else b""
                out.append((doc_id, n, int(gone.sum()), kept.decode("utf-8", "surrogatepass"), edges.tolist()))
        done = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_text", "edges"]).astype({"doc_id": "Int64"})
        yield done.assign(**{c: frame[c].to_numpy(dtype=object) for c in carried})


def substring_dedup(
    docs: DataFrame, group_bytes: int = GROUP_BYTES, heavy: int = HEAVY, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, removed_spans (first word, word after the last), then the
    columns of ``carry`` as they were.

    ``group_bytes`` of text give one group of suffixes; the number of groups follows the input.
    """
    small_batches(docs.sparkSession)
    carried = [f"_carried_{k}" for k in range(len(carry))]
    kinds = [f"{c} {dict(docs.dtypes)[name]}" for c, name in zip(carried, carry, strict=True)]
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(n).alias(c) for c, n in zip(carried, carry, strict=True))
    )
    named = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("tie"), "text", *carried)
    # One exchange of the texts serves all three passes: same columns, same filter, same key.
    texts = named.repartition("doc_id")
    squeezed = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    keys = cut_lineage(
        docs.select(
            "doc_id", F.xxhash64("text").alias("tie"), F.md5(squeezed).alias("words"), F.octet_length("text").alias("size")
        )
    )
    size = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(64, -(-int(size) // group_bytes))
    ids = keys.filter("doc_id IS NOT NULL")
    one = ids.groupBy("doc_id").agg(F.min("tie").alias("tie"), F.max("tie").alias("_u"))
    several = one.filter("tie <> _u").select("doc_id", F.col("tie").alias("keep"), F.lit(False).alias("copy"))
    plain = ids.join(several.select("doc_id", F.col("keep")), "doc_id", "left").filter("keep IS NULL OR keep = tie")
    copied = plain.groupBy("words").agg(F.min("doc_id").alias("_d"), F.max("doc_id").alias("_e")).filter("_d <> _e")
    copies = plain.join(copied, "words").filter("doc_id <> _d").select("doc_id", F.lit(None).cast("long"), F.lit(True))
    roles = several.union(copies).groupBy("doc_id").agg(F.max("keep").alias("keep"), F.max("copy").alias("copy"))
    roles = cut_lineage(roles)
    # role 1: the words of an earlier document; role 2: another text under a doc_id in use.
    role = F.when(F.col("keep") != F.col("tie"), 2).when(F.col("copy"), 1)
    texts = texts.join(roles, "doc_id", "left").select("doc_id", "text", role.alias("role"), *carried)
    searched = texts.filter("role IS NULL")

    anchors = searched.mapInPandas(_send_anchors(parts), _PACKED)
    hits = anchors.groupBy("part").applyInPandas(_repeated_anchors(heavy), "doc_id long, anchor long")
    per_text = hits.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    suffixes = searched.join(per_text, "doc_id").mapInPandas(_send_windows(parts), _PACKED)
    repeats = suffixes.groupBy("part").applyInPandas(_repeated, "doc_id long, run long")
    runs = repeats.groupBy("doc_id").agg(F.collect_set("run").alias("runs"))

    nothing = F.lit(None).cast("array<bigint>").alias("runs")
    nameless = docs.filter("doc_id IS NULL").select("doc_id", "text", nothing, F.lit(2).alias("role"), *carried)
    cut = (
        texts.join(runs, "doc_id", "left")
        .select("doc_id", "text", "runs", "role", *carried)
        .unionByName(nameless)
        .mapInPandas(_cut, ", ".join(["doc_id long, n_words long, n_removed long, kept_text string, edges array<long>", *kinds]))
    )
    pairs = F.transform(
        F.sequence(F.lit(0), F.expr("int(size(edges) / 2)") - 1),
        lambda i: F.struct(F.get("edges", 2 * i).alias("start"), F.get("edges", 2 * i + 1).alias("end")),
    )
    spans = F.when(F.size("edges") > 0, pairs).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_text", spans.alias("removed_spans"), *(F.col(c).alias(n) for c, n in zip(carried, carry, strict=True)))


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i AS start, md5(array_to_string(w[i + 1:i + 20], ' ')) AS h
  FROM d, LATERAL (SELECT unnest(range(0, greatest(len(w) - 19, 0))) AS i)
), gone AS (
  SELECT doc_id, start FROM (
    SELECT doc_id, start, row_number() OVER (PARTITION BY h ORDER BY doc_id, start) AS k FROM g
  ) WHERE k > 1
), p AS (
  SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d
), cover AS (
  SELECT DISTINCT doc_id, start + unnest(range(0, 20)) AS i FROM gone
), k AS (
  SELECT p.doc_id, count(*) AS n_removed FROM cover p GROUP BY ALL
), kept AS (
  SELECT p.doc_id, string_agg(w[p.i + 1], ' ' ORDER BY p.i) AS s
  FROM p LEFT JOIN cover c ON c.doc_id = p.doc_id AND c.i = p.i WHERE c.i IS NULL GROUP BY p.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op1_substring_dedup", SQL)
def op1(spark, folder):
    out = substring_dedup(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

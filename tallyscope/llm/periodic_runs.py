"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q, at least ``MIN_LENGTH`` words and ``MIN_POWER``
periods long, that no neighbouring word extends keeping period q.

The dictionary names the factors of a document whose length is a power of two: equal factors of 2^k words get
equal names, and the names of level k + 1 are those of pairs of names 2^k apart. At every level a place's
successor is the next place of the same factor. Successors within twice the factor's length, three places or
more that form an arithmetic progression, propose their difference as a period. A run of period q and four
periods shows at the level with q <= 2^k < 2q: there its first three places are q apart, and nearer ones would
make q no smallest period. Proposals are extended to both sides word by word, in blocks that double, and runs
that more than one level or place proposes are one by start and period.

A place whose factor occurs nowhere else in its document, or farther than a run of it could reach, belongs to no
longer factor either: it is left out of all further levels, so ordinary text ends after a few of them. All work is row-local,
memory a small multiple of the longest text, and nothing is shuffled.

Defined cases: null, empty and blank texts have no words and no runs; a null doc_id stays null; repeated rows
are treated alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .words import chunks

MIN_LENGTH = 6
MIN_POWER = 4
FIRST_BLOCK = 32


class Factors:
    """Level k of the dictionary: names of the places that are still of interest, in order of place."""

    def __init__(self, words: np.ndarray, last: np.ndarray, power: int):
        self.last, self.power, self.level = last, power, 0
        self.total = len(words)
        self.places = np.arange(self.total)
        self.keys = words
        self._name()

    def _name(self) -> None:
        """Successors by sorting; names are dense again, and places that can start no run go."""
        order = np.argsort(self.keys, kind="stable")
        keys, places = self.keys[order], self.places[order]
        same = np.concatenate([keys[1:] == keys[:-1], [False]])
        step = np.zeros(len(keys), np.int64)
        step[:-1] = np.where(same[:-1], places[1:] - places[:-1], 0)
        before = np.concatenate([[0], step[:-1]])
        name = np.cumsum(np.concatenate([[0], ~same[:-1]])) if len(keys) else keys
        # A run reaches at most its document, so a farther occurrence is no period of it.
        reach = (self.last[places]) // self.power
        keep = ((step > 0) & (step <= reach)) | ((before > 0) & (before <= reach))
        back = np.argsort(places[keep], kind="stable")
        self.places, self.names = places[keep][back], name[keep][back]
        self.steps = step[keep][back]

    def grow(self) -> bool:
        """To factors of twice the length; False when none is left."""
        size = 1 << self.level
        wide = np.full(self.total + size, -1, np.int64)
        wide[self.places] = self.names
        right = wide[self.places + size]
        held = right >= 0
        top = int(self.names.max(initial=0)) + 1
        self.places, self.keys = self.places[held], self.names[held] * top + right[held]
        self.level += 1
        self._name()
        return len(self.places) > 0

    def proposals(self) -> list[tuple[int, int]]:
        """(place, period) where three places follow each other at one distance; the first of each stretch."""
        steps = np.zeros(self.total + 1, np.int64)
        steps[self.places] = self.steps
        close = (self.steps > 0) & (self.steps <= 2 << self.level)
        places, step = self.places[close], self.steps[close]
        chain = steps[places + step] == step
        first = steps[places - 1] != step
        return list(zip(places[chain & first].tolist(), step[chain & first].tolist(), strict=True))


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of two equally long views are equal, read in blocks that double."""
    done, size = 0, FIRST_BLOCK
    while done < len(a):
        differ = a[done : done + size] != b[done : done + size]
        if differ.any():
            return done + int(differ.argmax())
        done, size = min(done + size, len(a)), size * 2
    return done


def extend(words: np.ndarray, place: int, period: int, low: int, high: int) -> tuple[int, int]:
    """Largest [start, end) in [low, high) around ``place`` that keeps the period."""
    right = _agree(words[place : high - period], words[place + period : high])
    left = _agree(words[low:place][::-1], words[low + period : place + period][::-1])
    return place - left, place + period + right


def runs_of(words: np.ndarray, offsets: np.ndarray, length: int = MIN_LENGTH, power: int = MIN_POWER) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of several documents, sorted by start and period.

    ``words`` holds their word numbers, different ones in different documents; document k has the places
    from offsets[k] up to offsets[k + 1].
    """
    sizes = np.diff(offsets)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    if not len(words):
        return out
    owner = np.repeat(np.arange(len(sizes)), sizes)
    factors = Factors(words, sizes[owner], power)
    found: set[tuple[int, int]] = set()
    reached: dict[int, list[tuple[int, int]]] = {}
    while True:
        for place, period in factors.proposals():
            known = reached.setdefault(period, [])
            if any(a <= place and place + period < b for a, b in known[-4:]):
                continue
            doc = owner[place]
            start, end = extend(words, place, period, int(offsets[doc]), int(offsets[doc + 1]))
            known.append((start, end))
            if (start, period) not in found and end - start >= max(length, power * period):
                found.add((start, period))
                out[doc].append((start - int(offsets[doc]), end - start, period))
        if not factors.grow():
            return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run is reduced to its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _batches(texts: list[bytes]):
    """(words, numbers, offsets) of whole texts, a few megabytes at a time."""
    for lo, hi in chunks(texts):
        split = [t.split() for t in texts[lo:hi]]
        numbers, base = [], 0
        for words in split:
            seen: dict[bytes, int] = {}
            fresh = count(base)
            own = np.fromiter((seen[w] if w in seen else seen.setdefault(w, next(fresh)) for w in words), np.int64, len(words))
            base += len(seen)
            numbers.append(own)
        yield split, np.concatenate(numbers), np.concatenate([[0], np.cumsum([len(w) for w in split])])


def _finder(length: int, power: int):
    def run(frames):
        for frame in frames:
            rows = []
            for split, numbers, offsets in _batches([t or b"" for t in frame["text"]]):
                for words, runs in zip(split, runs_of(numbers, offsets, length, power), strict=True):
                    keep = kept_words(len(words), runs) if runs else None
                    kept = words if keep is None else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    named = [{"start": a, "length": b, "period": c} for a, b, c in runs]
                    rows.append((len(words), named, b" ".join(kept)))
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            out = dict(zip(("n_words", "runs", "collapsed_text"), map(list, columns), strict=True))
            yield pd.DataFrame({"doc_id": frame["doc_id"].to_numpy(), **out}).astype({"doc_id": "Int64"})

    return run


def find_runs(docs: DataFrame, length: int = MIN_LENGTH, power: int = MIN_POWER) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and collapsed_text of every row.

    ``collapsed_text`` holds the words that stay, joined by one space. ``power`` may be four or more: below
    four periods the dictionary does not promise three places in a row.
    """
    if power < 4:
        raise ValueError("runs of fewer than four periods are not promised to be found")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed_text binary"
    return rows.mapInPandas(_finder(length, power), schema).withColumn("collapsed_text", F.col("collapsed_text").cast("string"))


def repeated_tails(docs: DataFrame) -> DataFrame:
    """In one of ten documents, by the checksum of doc_id, a tail of words repeats with a period.

    With h the checksum and g = h div 10, word i from a = g mod n on becomes word a + (i - a) mod p of the text,
    p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    marked = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_w"))
    marked = marked.withColumns({"_n": F.size("_w").cast("long"), "_g": F.floor(F.col("_h") / 10)})
    marked = marked.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    marked = marked.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))

    def moved(word: Column, i: Column) -> Column:
        return F.when(i < F.col("_a"), word).otherwise(F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))

    text = F.when(F.col("_n") > 0, F.array_join(F.transform("_w", moved), " ")).otherwise(F.col("text"))
    return marked.select("doc_id", text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Count, longest run and digests of the runs and of the collapsed text."""
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.withColumn("_top", longest)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_top.s")).alias("start"),
        F.col("_top.l").alias("length"),
        (-F.col("_top.p")).alias("period"),
        F.floor(F.expr("1000 * _top.l DIV -_top.p")).cast("long").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op13_periodic_runs")
def op13(spark, folder):
    return digests(find_runs(repeated_tails(table(spark, folder, "documents"))))

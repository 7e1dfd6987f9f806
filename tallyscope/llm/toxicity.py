"""Toxicity of texts after noisy-channel deobfuscation.

1. A character trigram model is counted over all texts (27 symbols: letters and "other", so the table
   has 19,683 entries at any size).
2. Suspicious tokens (letters mixed with look-alike signs, runs of a letter, single letters in a row or
   with separators) become a lattice: each sign stands for itself or for the letters it resembles, a
   run for one, two or all of its letters, separators for nothing or, between single letters, for a
   word border. Tokens have any length; punctuation around them is no part of them. Viterbi decoding finds the paths of
   least channel plus language-model cost; the ``PATHS`` best within ``SLACK`` of the best are kept. A
   token without alternatives has one path, itself, and isn't touched.
3. Features are the distinct words of the text and of its restored tokens, and their first 4, 5 and 6
   bytes. From at most ``FIT_ROWS`` labelled rows (chosen by hash) each feature that at least
   ``SUPPORT`` toxic rows hold, and whose log-likelihood ratio reaches ``EVIDENCE``, gets a smoothed
   log-odds weight; at most ``LEXICON`` are kept. A text's
   evidence is its largest weight and the sum of its distinct weights, and a logistic fit on the same
   rows makes that a probability.

Defined cases: null and empty texts carry no evidence and get the fit's base rate; a null doc_id can't
be labelled and is scored; labels other than 0 and 1 are unused, and of several labels of a document
the largest counts; without labels of both kinds every score is 0; repeated rows are repeated; an empty
table gives no rows; labels, lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import query, table
from .shared import cut_lineage, small_batches
from .words import _BYTE, _POW, Words, chunks, encode, mix

FIT_ROWS = 20_000
SUPPORT = 4
EVIDENCE = 10.0
LEXICON = 20_000
LEAST_WEIGHT = 3.0
THRESHOLD = 0.3
PATHS, SLACK = 6, 6.0
REMEMBERED, LONGEST = 100_000, 40
# A word has up to four features, so their texts go in smaller chunks.
FEATURE_BYTES = 500_000

# Signs and the letters they are read as.
LOOKS = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "g",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "*": "aeiou",
}
SIGNS = re.escape("".join(LOOKS))
TOKEN = rf"a-z{SIGNS}.\-_,'’"
# Other punctuation around a token isn't part of it. Possessive runs keep tokens of any length linear.
MIXED = re.compile(
    rf"(?<!\S)[^\w\s{SIGNS}]*+(?=[^\sa-z]*[a-z])(?=[a-z]*[{SIGNS}]|[a-z][.\-_][a-z])([{TOKEN}]{{3,}}+)[^\w\s]*+(?!\S)"
)
RUNS = re.compile(r"[a-z]*([a-z])\1\1[a-z]*")
SPACED = re.compile(rf"(?<!\S)[^\w\s{SIGNS}]*+([a-z{SIGNS}](?>[ .\-_*]{{1,2}}[a-z{SIGNS}](?![^\W_]|[@$|+(€])){{2,}}+)")

_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)


def count_trigrams(frames):
    total = np.zeros(27**3, np.int64)
    for frame in frames:
        texts = [encode(t) for t in frame["text"]]
        for lo, hi in chunks(texts):
            code = _CODE[np.frombuffer(b"  " + b"  ".join(texts[lo:hi]) + b"  ", np.uint8)]
            total += np.bincount(code[:-2] * 729 + code[1:-1] * 27 + code[2:], minlength=27**3)
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"gram": seen, "n": total[seen]})


def language_model(docs: DataFrame) -> np.ndarray:
    """Negative log probability of a symbol after two others; a table of fixed size."""
    rows = docs.select("text").mapInPandas(count_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.full(27**3, 0.1)
    for r in rows:
        counts[r["gram"]] += r["n"]
    counts = counts.reshape(27, 27, 27)
    return (-np.log(counts / counts.sum(2, keepdims=True))).astype(np.float32)


def _steps(token: str, borders: bool = False) -> list[list[tuple[str, float]]]:
    """The lattice of a token: per place its readings and their channel costs. With ``borders`` a
    separator can also end a word, which a wide one does more readily."""
    out, k = [], 0
    while k < len(token):
        c, run = token[k], 1
        while k + run < len(token) and token[k + run] == c:
            run += 1
        if c.isalpha() and c.isascii():
            readings = [(c * run, 0.0)] if run < 3 else [(c, 0.5), (c * 2, 0.5), (c * run, 4.0)]
        elif c in LOOKS:
            readings = [(letter * n, 1.0 + 0.5 * (n - 1)) for letter in LOOKS[c] for n in ({1, min(run, 2)})]
            readings.append(("", 3.0))
        else:
            readings = [("", 0.5)]
            if borders:
                readings = [("", 0.5 * run), (" ", 0.5 / run)]
        out.append(readings)
        k += run
    return out


_MOD = (1 << 61) - 1


def decode(token: str, costs: np.ndarray, paths: int = PATHS, slack: float = SLACK, borders: bool = False) -> list[str]:
    """Best readings of a token, best first (k-best Viterbi over states of the last two symbols).

    A path is a chain of readings and the hash of its text, so the work is linear in the length."""
    beams: dict[tuple[int, int], dict] = {(0, 0): {(0.0, 0): None}}
    for readings in _steps(token, borders):
        grown: dict[tuple[int, int], dict] = {}
        for (a, b), states in beams.items():
            for letters, channel in readings:
                x, y, cost, mark, scale = a, b, channel, 0, 1
                for c in letters:
                    z = 0 if c == " " else ord(c) - 96
                    cost += float(costs[x, y, z])
                    x, y = y, z
                    mark, scale = (mark * 1_000_003 + z + 1) % _MOD, scale * 1_000_003 % _MOD
                into = grown.setdefault((x, y), {})
                for (s, h), chain in states.items():
                    into.setdefault((s + cost, (h * scale + mark) % _MOD), (chain, letters) if letters else chain)
        beams = {k: {e: v[e] for e in sorted(v)[:paths]} for k, v in grown.items()}
    ends = sorted(((s + float(costs[a, b, 0]), h, a, b) for (a, b), v in beams.items() for s, h in v))
    best = ends[0][0] if ends else 0.0
    out = []
    for total, h, a, b in ends:
        if total > best + slack or len(out) >= paths:
            break
        chain, parts = next(v for (s, g), v in beams[a, b].items() if g == h and s + float(costs[a, b, 0]) == total), []
        while chain is not None:
            chain, letters = chain
            parts.append(letters)
        text = "".join(reversed(parts))
        if len(text) > 2 and text not in out:
            out.append(text)
    return out


class Restorer:
    """Restored readings of the suspicious tokens of a text."""

    def __init__(self, costs: np.ndarray):
        self.costs, self.known = costs, {}

    def __call__(self, text: str) -> str:
        low = text.lower()
        found = {m[1] for pattern in (MIXED, SPACED) for m in pattern.finditer(low)}
        found.update(m[0] for m in RUNS.finditer(low))
        if not found:
            return ""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = []
        for token in found:
            readings = self.known.get(token)
            if readings is None:
                readings = self.read(token)
                if len(token) <= LONGEST:
                    self.known[token] = readings
            out.append(readings)
        return " ".join(out)

    def read(self, token: str) -> str:
        ends = "|+*($.,'’-_!"
        pieces = [p for p in dict.fromkeys([token, token.rstrip(ends), token.strip(ends)]) if p == token or len(p) > 2]
        readings = [r for p in pieces for r in decode(re.sub(r"[ .\-_]", "", p) if " " in p else p, self.costs)]
        if SPACED.fullmatch(token):
            readings += decode(token, self.costs, borders=True)
        return " ".join(dict.fromkeys(readings))


_BREAK = np.full(256, 32, np.uint8)
for _k in (*range(48, 58), *range(97, 123), *range(128, 256)):
    _BREAK[_k] = _k
for _k in range(65, 91):
    _BREAK[_k] = _k + 32
_BREAK_TABLE = _BREAK.tobytes()


def feature_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word and its 4 to 6 byte beginnings; not yet distinct."""
    words = Words([t.translate(_BREAK_TABLE) for t in texts])
    owner = words.text_of_word()
    keys, owners = [words.hashes], [owner]
    raw = np.frombuffer(words.buffer, np.uint8)
    size = words.ends - words.starts
    for k in (4, 5, 6):
        long = np.flatnonzero(size > k)
        value = np.zeros(len(long), np.uint64)
        for j in range(k):
            value += _BYTE[raw[words.starts[long] + j]] * _POW[j]
        keys.append(mix(value + np.uint64(0xABCD * k)))
        owners.append(owner[long])
    return np.concatenate(owners), np.concatenate(keys)


def _restored(texts: list, restore: Restorer) -> list[bytes]:
    out = []
    for t in texts:
        more = restore(t) if isinstance(t, str) else ""
        out.append(encode(t) + (b" " + more.encode() if more else b""))
    return out


def _count_features(costs: np.ndarray):
    def run(frames):
        restore = Restorer(costs)
        for frame in frames:
            texts = _restored(list(frame["text"]), restore)
            toxic = frame["toxic"].to_numpy() == 1
            for lo, hi in chunks(texts, FEATURE_BYTES):
                owner, key = feature_hashes(texts[lo:hi])
                order = np.lexsort((owner, key))
                owner, key = owner[order], key[order]
                fresh = np.ones(len(key), bool)
                fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
                owner, key = owner[fresh], key[fresh]
                unique, back = np.unique(key, return_inverse=True)
                bad = np.bincount(back, weights=toxic[lo:hi][owner], minlength=len(unique)).astype(np.int64)
                every = np.bincount(back, minlength=len(unique))
                yield pd.DataFrame({"feature": unique.view(np.int64), "bad": bad, "good": every - bad})

    return run


class Model:
    """Character costs, sorted feature hashes with weights, and the logistic fit."""

    def __init__(self, costs, keys, weights, fit):
        self.costs, self.keys, self.weights, self.fit = costs, keys, weights, fit
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        """Largest weight and sum of distinct weights of each text."""
        out = np.zeros((len(texts), 2))
        if not len(self.keys):
            return out
        for lo, hi in chunks(texts, FEATURE_BYTES):
            owner, key = feature_hashes(texts[lo:hi])
            hit = np.flatnonzero(self.maybe[(key & np.uint64(0xFFFF)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
            real = self.keys[place] == key[hit]
            owner, place = owner[hit][real], place[real]
            pairs = np.unique(owner * len(self.keys) + place)
            owner, weight = pairs // len(self.keys) + lo, self.weights[pairs % len(self.keys)]
            np.maximum.at(out[:, 0], owner, weight)
            np.add.at(out[:, 1], owner, weight)
        return out

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if self.fit is None:
            return np.zeros(len(evidence))
        x = _design(evidence) @ self.fit
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _design(evidence: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(evidence)), evidence[:, 0], np.log1p(evidence[:, 1])])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge; three parameters."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 0.05 * w
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.05 * np.eye(len(w)), slope)
    return w


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(known: DataFrame, rows: int) -> DataFrame:
    """The ``rows`` rows with the smallest hashes of doc_id, all if there are fewer; each task sends that many at most."""
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, support: int = SUPPORT) -> Model:
    """Fit on rows that aren't held out; all texts take part in the language model."""
    small_batches(docs.sparkSession)
    costs = language_model(docs)
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(known, rows)
    sample = cut_lineage(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic"))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    none = Model(costs, np.zeros(0, np.uint64), np.zeros(0), None)
    if not bad or not good:
        return none
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 0.5) / (good + 1.0))
    # Log-likelihood ratio of the feature's own toxic share against the common one.
    every, base = F.col("bad") + F.col("good"), bad / (bad + good)
    rest = F.when(F.col("good") > 0, F.col("good") * F.log(F.col("good") / every / (1 - base))).otherwise(0.0)
    proof = F.col("bad") * F.log(F.col("bad") / every / base) + rest
    lexicon = (
        sample.mapInPandas(_count_features(costs), "feature long, bad long, good long")
        .groupBy("feature")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .filter(F.col("bad") >= support)
        .select("feature", odds.alias("weight"), proof.alias("proof"), "bad")
        .filter((F.col("weight") >= LEAST_WEIGHT) & (F.col("proof") >= EVIDENCE))
        .orderBy(F.desc(F.col("weight") * F.sqrt("bad")), "feature")
        .limit(LEXICON)
        .select("feature", "weight")
        .toPandas()
    )
    keys = lexicon["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    model = Model(costs, keys[order], lexicon["weight"].to_numpy(np.float64)[order], None)

    def measure(frames):
        restore = Restorer(costs)
        for frame in frames:
            e = model.evidence(_restored(list(frame["text"]), restore))
            yield pd.DataFrame({"top": e[:, 0], "all": e[:, 1], "toxic": frame["toxic"]})

    # At most FIT_ROWS rows of three numbers.
    seen = sample.mapInPandas(measure, "top double, all double, toxic int").toPandas()
    model.fit = _logistic(_design(seen[["top", "all"]].to_numpy()), seen["toxic"].to_numpy(float))
    return model


def score(model: Model, text: Column) -> Column:
    """Probability of label 1 for a text column."""

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restore = Restorer(model.costs)
        for texts in batches:
            yield pd.Series(model.probability(model.evidence(_restored(list(texts), restore))))

    return scored(text)


@query("op2_toxicity")
def op2(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = train(docs, table(spark, folder, "labels").select("doc_id", "toxic"))
    out = docs.select("doc_id", held_out().alias("held_out"), score(model, F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

"""Bounded-space online packing of token sequences.

Each partition reads its texts in order and keeps at most ``OPEN`` windows open. A piece goes to the
open window with the least room that still holds it (best fit). If none does, a new window is opened;
with ``OPEN`` windows open already, the fullest is emitted: a gap of at least ``MIN_CUT`` ids is first
filled with the front of the piece, a smaller one is left to padding. Texts longer than a window give
full windows and a rest. What is open at the end of a partition is merged in groups of ``MERGE``
partitions: whole windows best fit first, then the emptiest are poured into the fullest, so a group
ends with one window that isn't full. Memory is bounded by ``OPEN`` (or ``OPEN * MERGE``) windows.

Defined cases: null text is empty and gives the closing id alone; a null doc_id stays null; repeated
rows are packed like any others; an empty table gives no rows; extra columns are ignored. Strings that
spell a special token are that token, as the tokenizer has it.
"""

from __future__ import annotations

import os
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .shared import cut_lineage, small_batches
from .words import Words, chunks, encode, ragged

LENGTH = 2048
OPEN = 64
MIN_CUT = 16
MERGE = 16
CLOSING_ID = 1
CACHED_WORDS = 1_000_000
MARKS = ".,!?;:"

_SCHEMA = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open int"
_COLUMNS = [c.split()[0] for c in _SCHEMA.split(", ")]


class Encoder:
    """Ids of whole texts; white space separates words for this tokenizer, so each new word is encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        words = Words(texts)
        unique, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHED_WORDS:
            self.forget()
        place = np.searchsorted(self.keys, unique)
        held = np.zeros(len(unique), bool)
        held[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] == unique[place < len(self.keys)]
        new = np.flatnonzero(~held)
        at = first[new]
        spans = zip(words.starts[at].tolist(), words.ends[at].tolist(), strict=True)
        fresh = self._encoded([words.buffer[a:b].decode("utf-8", "replace") for a, b in spans])
        self.keys = np.insert(self.keys, place[new], unique[new])
        self.number = np.insert(self.number, place[new], np.arange(len(new)) + len(self.sizes))
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, fresh), np.int64, len(fresh)) // 4])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(fresh), "<u4")])
        ids, ends = ragged(self.ids, self.sizes, self.number[np.searchsorted(self.keys, unique)][back])
        cuts = np.concatenate([[0], ends])[words.offsets]
        end = np.asarray([CLOSING_ID], "<u4").tobytes()
        return [ids[a:b].tobytes() + end for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def forget(self) -> None:
        """No word is known: sorted hashes, the number of each one's word, and sizes and ids in the order of numbers."""
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _each(self, words: list[str]) -> list[bytes]:
        # Without offsets, which nothing here needs.
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. Letters followed by marks are two units for this tokenizer, and each run
        of letters ends with a closing piece, so many runs are encoded in one call and cut apart there."""
        cores = [w.rstrip(MARKS) if w[-1] in MARKS else w for w in words]
        plain = list(dict.fromkeys(c for c in cores if c.isalpha() and c.lower().isalpha()))
        known: dict[str, bytes] = {}
        for lo in range(0, len(plain), 2000):
            part = plain[lo : lo + 2000]
            (found,) = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            ids = np.asarray(found.ids, "<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) == len(part) and ends[-1] == 4 * len(ids):
                body = ids.tobytes()
                ends = ends.tolist()
                known.update(zip(part, [body[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
            else:
                known.update(zip(part, self._each(part), strict=True))
        rest = list(dict.fromkeys(w[len(c) :] if c in known else w for w, c in zip(words, cores, strict=True) if c is not w or c not in known))
        other = dict(zip(rest, self._each(rest), strict=True))
        return [
            (known[c] if c is w else known[c] + other[w[len(c) :]]) if c in known else other[w]
            for w, c in zip(words, cores, strict=True)
        ]


class Packer:
    """Windows of one task: pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, length: int, room: int, first_id: int):
        self.length, self.room, self.next_id = length, room, first_id
        self.windows: list[tuple[int, list]] = []
        self.full: list[list] = []

    def add(self, piece) -> None:
        doc_id, start, ids, total = piece
        while len(ids) >= 4 * self.length:
            self.full.append([(doc_id, start, ids[: 4 * self.length], total)])
            start, ids = start + self.length, ids[4 * self.length :]
        if not ids:
            return
        size = len(ids) // 4
        fits = [k for k, (fill, _) in enumerate(self.windows) if fill + size <= self.length]
        if fits:
            k = max(fits, key=lambda k: self.windows[k][0])
            fill, pieces = self.windows[k]
            pieces.append((doc_id, start, ids, total))
            self.windows[k] = (fill + size, pieces)
            if fill + size == self.length:
                self.full.append(self.windows.pop(k)[1])
            return
        if len(self.windows) >= self.room:
            fill, pieces = self.windows.pop(max(range(len(self.windows)), key=lambda k: self.windows[k][0]))
            gap = self.length - fill
            if gap >= MIN_CUT:
                pieces.append((doc_id, start, ids[: 4 * gap], total))
                start, ids = start + gap, ids[4 * gap :]
            self.full.append(pieces)
        self.windows.append((len(ids) // 4, [(doc_id, start, ids, total)]))

    def pour(self) -> None:
        """Empty the emptiest windows into the fullest; at most one stays short."""
        left = sorted(self.windows, key=lambda w: w[0])
        while left:
            fill, pieces = left.pop()
            while fill < self.length and left:
                small, donor = left[0]
                doc_id, start, ids, total = donor.pop()
                take = min(self.length - fill, len(ids) // 4)
                pieces.append((doc_id, start, ids[: 4 * take], total))
                fill += take
                if 4 * take < len(ids):
                    donor.append((doc_id, start + take, ids[4 * take :], total))
                left[0] = (small - take, donor)
                if not donor:
                    left.pop(0)
            self.full.append(pieces)
        self.windows = []

    def emit(self, open_too: bool, with_ids: bool) -> pd.DataFrame:
        rows = []
        groups = [(0, p) for p in self.full] + ([(1, p) for _, p in self.windows] if open_too else [])
        for still_open, pieces in groups:
            offset = 0
            for doc_id, start, ids, total in pieces:
                size = len(ids) // 4
                body = ids if with_ids or still_open else None
                rows.append((doc_id, start, size, body, zlib.crc32(ids), total, self.next_id, offset, still_open))
                offset += size
            self.next_id += 1
        self.full = []
        return pd.DataFrame(rows, columns=_COLUMNS).astype({"doc_id": "Int64"})


def _pack(path: str, length: int, room: int, with_ids: bool):
    def run(frames):
        packer = Packer(length, room, TaskContext.get().partitionId() << 32)
        encoder = Encoder(path)
        for frame in frames:
            texts = [encode(t) for t in frame["text"]]
            docs = [None if pd.isna(d) else int(d) for d in frame["doc_id"]]
            for lo, hi in chunks(texts):
                for doc_id, ids in zip(docs[lo:hi], encoder(texts[lo:hi]), strict=True):
                    packer.add((doc_id, 0, ids, len(ids) // 4))
                yield packer.emit(False, with_ids)
        yield packer.emit(True, with_ids)

    return run


def _merge(length: int, room: int, with_ids: bool):
    def run(key, frame):
        packer = Packer(length, room * MERGE, (1 << 62) | int(key[0]) << 32)
        frame = frame.sort_values(["sequence_id", "offset"])
        filled = []
        for _, window in frame.groupby("sequence_id", sort=True):
            pieces = [
                (None if pd.isna(d) else int(d), int(s), bytes(i), int(t))
                for d, s, i, t in window[["doc_id", "start", "ids", "doc_tokens"]].itertuples(index=False)
            ]
            filled.append((sum(len(p[2]) for p in pieces) // 4, pieces))
        for fill, pieces in sorted(filled, key=lambda w: -w[0]):
            fits = [k for k, (f, _) in enumerate(packer.windows) if f + fill <= length]
            if fits:
                k = max(fits, key=lambda k: packer.windows[k][0])
                packer.windows[k] = (packer.windows[k][0] + fill, packer.windows[k][1] + pieces)
            else:
                packer.windows.append((fill, pieces))
        packer.pour()
        return packer.emit(False, with_ids)

    return run


def pack(
    docs: DataFrame, tokenizer_file: str, length: int = LENGTH, open_windows: int = OPEN, with_ids: bool = True
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit; null unless
    ``with_ids``), ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = cut_lineage(docs.mapInPandas(_pack(tokenizer_file, length, open_windows, with_ids), _SCHEMA))
    rest = (
        packed.filter("open = 1")
        .withColumn("merge", F.shiftright("sequence_id", 32) / MERGE)
        .withColumn("merge", F.floor("merge"))
        .groupBy("merge")
        .applyInPandas(_merge(length, open_windows, with_ids), _SCHEMA)
    )
    return packed.filter("open = 0").unionByName(rest).drop("open")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_packing")
def op5(spark, folder):
    return pack(table(spark, folder, "documents"), default_tokenizer(), with_ids=False).drop("ids")

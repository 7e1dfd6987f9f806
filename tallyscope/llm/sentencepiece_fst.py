"""SentencePiece encoding and decoding as a weighted transducer with shortest paths.

Compiled from the model file: the normaliser (escaped white space, optional dummy prefix, optional
removal of extra spaces), the pieces as a trie, and byte fallback (or the unknown piece) for characters
without a piece. Composed with an input this is a lattice whose states are (position, last piece) and
whose arcs are pieces; the result is its shortest path in the tropical semiring (weights add along a path,
the smallest sum wins, of equal ones the one with the longer last arc).

Weights. In a unigram model a piece weighs minus its score. In a BPE model a path is right if merging
would give it, which holds when it holds for each two neighbours: an arc weighs 0 if merging the last piece
and this one alone gives the two again, and infinity if not. Then each state is reached by one piece at most.

No piece holds a space after another character, so texts fall into units at spaces (and at line ends,
which no piece holds). The distinct units of a chunk of texts are composed together: the trie is walked from all
their characters at once, and the arcs are relaxed by the place where they end. Between chunks only verdicts
on neighbours and tokens of few ids are remembered, in tables of ``SLOTS`` and ``TOKEN_SLOTS`` entries whose older
ones are overwritten, so memory follows ``CHUNK`` (or the longest text), not the number of distinct words.

Defined cases: null and empty texts have no ids; repeated rows are repeated; ids outside the vocabulary
are refused in decoding; control pieces decode to nothing; a literal U+2581 decodes to a space as in the
model itself; an empty table gives no rows; extra columns are ignored; character maps, user-defined and
unused pieces, and models that are neither BPE nor unigram are refused.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .words import Words, chunks, mix, ragged

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
CHUNK = 2_000_000
SLOTS = 1 << 20
TOKEN_SLOTS, TOKEN_IDS = 1 << 19, 8
REMEMBERED = 50_000
LONG = 64


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class Trie:
    """Pieces as a trie in sorted arrays, walked from many places at once."""

    def __init__(self, pieces: dict[str, int]):
        alphabet = sorted(set("".join(pieces)))
        self.width = len(alphabet) + 1
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[[ord(c) for c in alphabet]] = np.arange(1, self.width)
        place = {c: k for k, c in enumerate(alphabet, 1)}
        steps: dict[int, int] = {}
        final: dict[int, int] = {}
        for piece, number in pieces.items():
            node = 0
            for c in piece:
                node = steps.setdefault(node * self.width + place[c], len(steps) + 1)
            final[node] = number
        self.keys = np.fromiter(sorted(steps), np.int64, len(steps))
        self.next = np.fromiter((steps[k] for k in self.keys.tolist()), np.int64, len(steps))
        self.final = np.full(len(steps) + 1, -1, np.int32)
        self.final[list(final)] = list(final.values())

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The nodes reached, -1 where there is none."""
        wanted = node * self.width + symbol
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == wanted) & (symbol > 0), self.next[at], -1)


class Transducer:
    """The compiled model; states and arcs are built for the units of a chunk."""

    def __init__(self, data: bytes):
        pieces, norm, trainer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                score = struct.unpack("<f", f[2])[0] if 2 in f else 0.0
                pieces.append((f.get(1, b"").decode(), score, f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if norm.get(2):
            raise ValueError("the model has a character map; only identity normalisers are compiled")
        if trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE):
            raise ValueError("the model is neither a BPE nor a unigram model")
        if any(kind in (USER, UNUSED) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not compiled")
        self.bpe = trainer.get(3, UNIGRAM) == BPE
        self.dummy, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.pieces = pieces
        self.ids = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.scores = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.bytes = {int(p[3:5], 16): k for k, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_ids = np.asarray([self.bytes.get(b, 0) for b in range(256)], "<i4")
        self.unknown = next(k for k, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN)
        self.longest = max(map(len, self.ids))
        apart = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        lines = not any("\n" in p for p in self.ids)
        # White space inside longer pieces doesn't end a unit; texts that hold it are composed as they are.
        self.joined = bytes(c for c in b"\t\n\r\x0b\x0c " if any(chr(c) in p for p in self.ids if len(p) > 1))
        self.by_words = apart and not self.squeeze
        if apart and lines:
            self.units = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n|{SPACE}+").findall
        else:
            self.units = lambda text: [text] if text else []
        self.allowed: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, int], list | None] = {}
        self.output = self._outputs()
        # Numbers beyond the vocabulary: a character without a piece, and the start of a unit.
        self.fallback, self.start = len(pieces), len(pieces) + 1

    @cached_property
    def last_merge(self) -> dict[str, list[str]]:
        """The two parts of every longer piece that merging its own characters gives back."""
        halves = ((p, self.merged(p, 2)) for p in self.ids if len(p) > 1)
        return {p: parts for p, parts in halves if len(parts) == 2}

    @cached_property
    def arcs(self) -> dict[str, int]:
        """Arcs of the piece machine: all pieces of a unigram model, in a BPE model those that merging gives."""
        return {p: k for p, k in self.ids.items() if not self.bpe or len(p) == 1 or p in self.last_merge}

    @cached_property
    def trie(self) -> Trie:
        return Trie(self.arcs)

    @cached_property
    def weights(self) -> np.ndarray:
        """Of pieces by number, and last of a character without a piece."""
        if self.bpe:
            return np.zeros(len(self.pieces) + 1, np.float32)
        lowest = np.float32(min(self.scores.values())) - np.float32(UNKNOWN_PENALTY)
        return -np.asarray([*(s for _, s, _ in self.pieces), lowest], np.float32)

    def merged(self, text: str, until: int = 1) -> list[str]:
        """Merging by score, leftmost first, down to ``until`` parts: the model's own rule."""
        parts: list[str | None] = list(text)
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []
        left = len(parts)

        def offer(a: int, b: int):
            if a >= 0 and b >= 0:
                both = parts[a] + parts[b]
                if both in self.scores:
                    heapq.heappush(heap, (-self.scores[both], a, b, both))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap and left > until:
            _, a, b, both = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, None
            left -= 1
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def edge(self, piece: str, side: int) -> list[tuple[str, float, float]] | None:
        """The outermost parts (last for side 1, first for side 0) that a piece has while it is merged,
        each with the times of its birth and its end; None if merging doesn't give the piece."""
        key = (piece, side)
        if key not in self.edges:
            if len(piece) == 1:
                self.edges[key] = [(piece, -math.inf, math.inf)]
            elif piece not in self.last_merge:
                self.edges[key] = None
            else:
                born = -self.scores[piece]
                inner = self.edge(self.last_merge[piece][side], side)
                self.edges[key] = [(piece, born, math.inf), *((p, a, min(z, born)) for p, a, z in inner)]
        return self.edges[key]

    def follows(self, x: str, y: str) -> bool:
        """Whether y may come after x: no merge across the border happens while its two parts exist. Of
        equal merges the left one comes first."""
        key = (x, y)
        if key not in self.allowed:
            if len(self.allowed) > REMEMBERED:
                self.allowed.clear()
            self.allowed[key] = self._apart(x, y)
        return self.allowed[key]

    def _apart(self, x: str, y: str) -> bool:
        if x[-1] == SPACE and y[0] == SPACE:
            return self.merged(x + y) == [x, y]
        scores = self.scores
        for p, p_born, p_end in self.edge(x, 1):
            for q, q_born, q_end in self.edge(y, 0):
                if p + q in scores:
                    at = -scores[p + q]
                    if at >= p_born and at >= q_born and at < p_end and at <= q_end:
                        return False
        return True

    @cached_property
    def borders(self):
        """For both sides: part numbers, births and ends of the outermost parts of every piece, in columns."""
        sides = []
        for side in (0, 1):
            lists = {k: self.edge(p, side) or [] for p, k in self.arcs.items()}
            depth = max(map(len, lists.values()))
            part = np.full((len(self.pieces) + 2, depth), -1, np.int64)
            born, end = np.zeros(part.shape), np.zeros(part.shape)
            for k, parts in lists.items():
                for d, (p, a, z) in enumerate(parts):
                    part[k, d], born[k, d], end[k, d] = self.ids.get(p, -1), a, z
            sides.append((part, born, end))
        self.edges.clear()
        return sides

    @cached_property
    def joins(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of pieces that merge into a piece, sorted, and the time of the merge."""
        count = len(self.pieces)
        found = {}
        for piece, score in self.scores.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    found[a * count + b] = -score
        keys = np.fromiter(sorted(found), np.int64, len(found))
        return np.append(keys, np.iinfo(np.int64).max), np.asarray([*(found[k] for k in keys.tolist()), 0.0])

    @cached_property
    def blank(self) -> np.ndarray:
        """Whether a piece begins (row 0) or ends (row 1) with a space."""
        out = np.zeros((2, len(self.pieces) + 2), bool)
        for p, k in self.ids.items():
            out[:, k] = p[0] == SPACE, p[-1] == SPACE
        return out

    @cached_property
    def verdicts(self) -> np.ndarray:
        return np.full(SLOTS, -1, np.int64)

    @cached_property
    def recent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, ids and number of ids of recent tokens."""
        return np.zeros(TOKEN_SLOTS, np.uint64), np.zeros((TOKEN_SLOTS, TOKEN_IDS), "<i4"), np.zeros(TOKEN_SLOTS, np.int64)

    def follow_many(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``follows`` by piece numbers."""
        key = x.astype(np.int64) * (self.start + 1) + y
        slot = (mix(key.astype(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)
        held = self.verdicts[slot]
        out = (held & 1).astype(bool)
        if len(miss := np.flatnonzero((held >> 1) != key)):
            new, at, back = np.unique(key[miss], return_index=True, return_inverse=True)
            ok = self._apart_many(x[miss[at]], y[miss[at]])
            out[miss] = ok[back]
            self.verdicts[slot[miss[at]]] = new * 2 + ok
        return out

    def _apart_many(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        (left, left_born, left_end), (right, right_born, right_end) = self.borders
        keys, times = self.joins
        ok = np.ones(len(x), bool)
        # All outermost parts of x beside all of y.
        many, across = (right[x] >= 0).sum(1), (left[y] >= 0).sum(1)
        count = many * across
        k = np.repeat(np.arange(len(x)), count)
        i, j = np.divmod(np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count), across[k])
        wanted = right[x[k], i] * len(self.pieces) + left[y[k], j]
        at = np.searchsorted(keys, wanted)
        hit = np.flatnonzero(keys[at] == wanted)
        k, i, j, time = k[hit], i[hit], j[hit], times[at[hit]]
        a, b = x[k], y[k]
        clash = (time >= right_born[a, i]) & (time >= left_born[b, j]) & (time < right_end[a, i]) & (time <= left_end[b, j])
        ok[k[clash]] = False
        for k in np.flatnonzero(self.blank[1][x] & self.blank[0][y]):
            ok[k] = self.follows(self.pieces[x[k]][0], self.pieces[y[k]][0])
        return ok

    def shortest_path(self, unit: str) -> list[str]:
        """The pieces (or single characters without a piece) of one unit, relaxed place by place: the form
        for units above ``LONG`` characters."""
        size, longest, arcs, weights = len(unit), self.longest, self.arcs, self.weights
        cost = [np.float32(0), *[np.float32(math.inf)] * size]
        last = [""] * (size + 1)
        for end in range(1, size + 1):
            for start in range(max(0, end - longest), end):
                arc = unit[start:end]
                if (arc in arcs or end - start == 1) and cost[start] < math.inf:
                    total = cost[start] + weights[arcs.get(arc, self.fallback)]
                    if total < cost[end] and (not self.bpe or not start or self.follows(last[start], arc)):
                        cost[end], last[end] = total, arc
        path, end = [], size
        while end:
            if not last[end]:
                raise ValueError("no path of finite weight")
            path.append(last[end])
            end -= len(last[end])
        return path[::-1]

    def lattice(self, chars: np.ndarray, left: np.ndarray):
        """Arcs of all units: place of the first character, length and piece number. ``left`` counts the
        characters from a place to the end of its unit."""
        symbols = self.trie.symbol[chars].astype(np.int64)
        place = np.arange(len(chars))
        node = self.trie.step(np.zeros(len(chars), np.int64), symbols)
        single = np.where(node >= 0, self.trie.final[node], -1)
        found = [(place, np.ones(len(chars), np.int64), np.where(single >= 0, single, self.fallback))]
        length = 1
        while len(place):
            on = np.flatnonzero((node >= 0) & (left[place] > length))
            place = place[on]
            node = self.trie.step(node[on], symbols[place + length])
            length += 1
            final = np.where(node >= 0, self.trie.final[node], -1)
            k = np.flatnonzero(final >= 0)
            found.append((place[k], np.full(len(k), length), final[k]))
        return [np.concatenate(column) for column in zip(*found, strict=True)]

    def compose(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units in a row, and how many each one has."""
        if not units:
            return np.zeros(0, "<i4"), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(units)), sizes)
        offset = np.arange(len(chars)) - np.repeat(ends - sizes, sizes)
        # State k of the flat lattice is the place before character k - (number of its unit).
        piece = np.full(len(chars) + len(units), -1, np.int64)
        span = np.zeros(len(piece), np.int64)
        short = sizes <= LONG
        self._relax(chars, sizes[owner] - offset, owner, offset, short[owner], piece, span)
        path = np.zeros(len(piece), bool)
        first = ends - sizes + np.arange(len(units))
        at, begin = (first + sizes)[short & (sizes > 0)], first[short & (sizes > 0)]
        while len(at):
            if (piece[at] < 0).any():
                raise ValueError("no path of finite weight")
            path[at] = True
            at = at - span[at]
            on = at > begin
            at, begin = at[on], begin[on]
        for k in np.flatnonzero(~short):
            place = first[k]
            for part in self.shortest_path(units[k]):
                place += len(part)
                path[place], piece[place] = True, self.arcs.get(part, self.fallback)
        states = np.flatnonzero(path)
        return self._emit(piece[states], chars, states, first)

    def _relax(self, chars, left, owner, offset, keep, piece, span):
        """Sets the best last piece of every state, by the place in the unit where arcs end."""
        start, length, number = self.lattice(chars, np.where(keep, left, 0))
        on = keep[start]
        start, length, number = start[on], length[on], number[on]
        stop = offset[start] + length
        order = np.argsort((stop * (LONG + 1) + LONG - length).astype(np.uint16), kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(stop, minlength=1))])
        cost = np.full(len(piece), np.inf, np.float32)
        first = offset[start] == 0
        source = start + owner[start]
        cost[source[first]] = 0
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            k = order[a:b]
            k = k[cost[source[k]] < np.inf]
            if self.bpe:
                later = np.flatnonzero(~first[k])
                fine = np.ones(len(k), bool)
                fine[later] = self.follow_many(piece[source[k[later]]], number[k[later]])
                k = k[fine]
            target = source[k] + length[k]
            total = cost[source[k]] + self.weights[number[k]]
            np.minimum.at(cost, target, total)
            best = np.flatnonzero(total == cost[target])[::-1]
            piece[target[best]], span[target[best]] = number[k[best]], length[k[best]]

    def _emit(self, pieces, chars, states, first):
        """The output side: ids, and for characters without a piece their bytes or the unknown piece."""
        owner = np.searchsorted(first, states, "right") - 1
        bare = np.flatnonzero(pieces == self.fallback)
        count = np.ones(len(pieces), np.int64)
        values = pieces.astype("<i4")
        if len(bare) and self.bytes:
            code = chars[states[bare] - owner[bare] - 1]
            count[bare] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            values = np.repeat(values, count)
            raw = code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            values[values == self.fallback] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        elif len(bare):
            values[bare] = self.unknown
        return values, np.bincount(owner, count, len(first)).astype(np.int64)

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((" " if self.dummy else "") + text).replace(" ", SPACE)

    def encode(self, text: str) -> bytes:
        """Ids of one text; each distinct unit is composed once."""
        numbers: dict[str, int] = {}
        index = [numbers.setdefault(u, len(numbers)) for u in self.units(self.normalise(text))]
        flat, sizes = self.compose(list(numbers))
        return self._fused(ragged(flat, sizes, np.asarray(index, np.int64))[0])

    def _fused(self, ids: np.ndarray) -> bytes:
        """Without byte fallback a run of unknown characters is one unknown piece."""
        if not self.bytes and len(ids):
            again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
            ids = ids[np.concatenate([[True], ~again])]
        return ids.astype("<i4").tobytes()

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts. A word with the white space before it is a token; each distinct token of
        a chunk is composed once, and the ids are laid out by index."""
        plain = [
            self.by_words and not (SPACE.encode() in t or any(c in t for c in self.joined)) for t in texts
        ]
        out = [b""] * len(texts)
        rest = [k for k, p in enumerate(plain) if p]
        some = [texts[k] for k in rest]
        for lo, hi in chunks(some, CHUNK):
            for k, ids in zip(rest[lo:hi], self._encode_chunk(some[lo:hi]), strict=True):
                out[k] = ids
        for k, text in enumerate(texts):
            if not plain[k]:
                out[k] = self.encode(text.decode("utf-8", "surrogatepass"))
        return out

    def _encode_chunk(self, texts: list[bytes]) -> list[bytes]:
        words = Words(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        text_starts = np.cumsum(sizes) - sizes
        owner = words.text_of_word()
        first = np.zeros(len(owner), bool)
        first[words.offsets[:-1][np.diff(words.offsets) > 0]] = True
        before = np.empty(len(owner), np.int64)
        before[1:] = words.ends[:-1]
        before[first] = text_starts[owner[first]]
        raw = np.frombuffer(words.buffer, np.uint8)
        gap = words.starts - before
        code = np.where(gap == 1, raw[before], 0).astype(np.uint64)
        for k in np.flatnonzero(gap > 1):
            code[k] = 256 + int.from_bytes(words.buffer[before[k] : words.starts[k]], "big") % (2**61 - 1)
        code = code * np.uint64(2) + first
        keys = mix(words.hashes + mix(code + np.uint64(77)))
        unique, at, back = np.unique(keys, return_index=True, return_inverse=True)
        # Tokens of few ids that an earlier chunk composed and no other has overwritten since.
        held, held_ids, held_count = self.recent
        slot = (unique & np.uint64(TOKEN_SLOTS - 1)).astype(np.int64)
        known = (held[slot] == unique) & (held_count[slot] > 0)
        fresh = np.flatnonzero(~known)
        units: list[str] = []
        counts = [0]
        for b, e, new in zip(before[at[fresh]].tolist(), words.ends[at[fresh]].tolist(), first[at[fresh]].tolist(), strict=True):
            text = words.buffer[b:e].decode("utf-8", "surrogatepass")
            units += self.units(self.normalise(text) if new else text.replace(" ", SPACE))
            counts.append(len(units))
        flat, lengths = self.compose(units)
        until = np.concatenate([[0], np.cumsum(lengths)])[np.asarray(counts)]
        sizes_new = np.diff(until)
        slots, columns = slot[known], np.arange(held_ids.shape[1])
        packed = np.concatenate([held_ids[slots][columns < held_count[slots][:, None]], flat])
        sizes_all = np.concatenate([held_count[slots], sizes_new])
        place = np.empty(len(unique), np.int64)
        place[np.concatenate([np.flatnonzero(known), fresh])] = np.arange(len(unique))
        # One writer a slot.
        few = np.flatnonzero((sizes_new > 0) & (sizes_new <= held_ids.shape[1]))
        few = few[np.unique(slot[fresh[few]], return_index=True)[1]]
        into, inside = slot[fresh[few]], columns < sizes_new[few][:, None]
        rows = np.zeros(inside.shape, "<i4")
        rows[inside] = ragged(flat, sizes_new, few)[0]
        held[into], held_ids[into], held_count[into] = unique[fresh[few]], rows, sizes_new[few]
        ids, ends = ragged(packed, sizes_all, place[back])
        cuts = np.concatenate([[0], ends])[words.offsets]
        out = []
        for k, text in enumerate(texts):
            if words.offsets[k] == words.offsets[k + 1]:
                out.append(self.encode(text.decode("utf-8", "surrogatepass")))
                continue
            body = ids[cuts[k] : cuts[k + 1]]
            tail = words.buffer[words.ends[words.offsets[k + 1] - 1] : text_starts[k] + len(text)]
            if tail:
                body = np.concatenate([body, self.compose(self.units(tail.decode().replace(" ", SPACE)))[0]])
            out.append(self._fused(body))
        return out

    def decode_batch(self, encoded: list[bytes]) -> list[str]:
        """Texts of id sequences: the outputs of the pieces laid out by index."""
        out: list[str] = []
        sizes = np.fromiter(map(len, self.output), np.int64, len(self.output))
        flat = np.frombuffer(b"".join(self.output), np.uint8)
        for lo, hi in chunks(encoded, CHUNK):
            part = encoded[lo:hi]
            text, ends = ragged(flat, sizes, np.frombuffer(b"".join(part), "<i4"))
            cuts = np.cumsum([0, *(len(p) // 4 for p in part)])
            cuts = np.concatenate([[0], ends])[cuts]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                plain = text[a:b].tobytes().decode("utf-8", "replace")
                out.append(plain[1:] if self.dummy and plain.startswith(" ") else plain)
        return out

    def _outputs(self) -> list[bytes]:
        out = []
        for k, (piece, _, kind) in enumerate(self.pieces):
            if kind == BYTE:
                out.append(bytes([int(piece[3:5], 16)]))
            elif kind == CONTROL:
                out.append(b"")
            elif k == self.unknown:
                out.append(" ⁇ ".encode())
            else:
                out.append(piece.replace(SPACE, " ").encode())
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join([self.output[k] for k in np.frombuffer(ids, "<i4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    with open(path, "rb") as f:
        return Transducer(f.read())


def _encode(path: str):
    def run(frames):
        fst = transducer(path)
        for frame in frames:
            ids = fst.encode_batch([t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in frame["text"]])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "ids": ids, "n_ids": [len(i) // 4 for i in ids]})

    return run


def _decode(path: str):
    def run(frames):
        fst = transducer(path)
        for frame in frames:
            yield frame.assign(text=fst.decode_batch(list(frame["ids"])))

    return run


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit), n_ids."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInPandas(_encode(model_file), f"doc_id {kind}, ids binary, n_ids long")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """The encoded rows with their text."""
    kind = dict(encoded.dtypes)["doc_id"]
    rows = encoded.select("doc_id", "ids", "n_ids")
    return rows.mapInPandas(_decode(model_file), f"doc_id {kind}, ids binary, n_ids long, text string")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """``decode(encode(docs))`` in one pass, so that an executor holds one Python worker a core and no ids travel."""
    kind = dict(docs.dtypes)["doc_id"]
    back, forth = _decode(model_file), _encode(model_file)
    rows = docs.select("doc_id", "text")
    return rows.mapInPandas(lambda frames: back(forth(frames)), f"doc_id {kind}, ids binary, n_ids long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op10_sentencepiece")
def op10(spark, folder):
    back = round_trip(table(spark, folder, "documents"), default_model())
    return back.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))

"""Word hashes of whole texts, computed on byte arrays for a batch of documents at a time."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20_240_517)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_ROW = 1 << 16
_POW = np.concatenate([[np.uint64(1)], np.full(_ROW - 1, _BASE)]).astype(np.uint64).cumprod(dtype=np.uint64)
_ROW_POW = (_POW[-1:] * _BASE)[0]

CHUNK_BYTES = 2_000_000
# Bytes that are hashed at once: work arrays hold eight bytes for each of them.
STRETCH = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche step: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Words:
    """Words of several texts: hashes, byte spans in ``buffer`` and the first word of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.buffer = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.buffer, np.uint8)
        if lower:
            raw = _LOWER[raw]
        space = _SPACE[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        self.starts, self.ends = edges[0::2], edges[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        text_ends = np.cumsum(sizes)
        self.offsets = np.searchsorted(self.starts, np.concatenate([[0], text_ends]))
        self.hashes = self._hash(raw)

    def _hash(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sums = np.empty(len(self.starts), np.uint64)
        first = 0
        while first < len(sums):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + STRETCH)))
            end = self.starts[last] if last < len(sums) else len(raw)
            sums[first:last] = self._sums(raw[self.starts[first] : end], first, last)
            first = last
        return mix(sums + (self.ends - self.starts).astype(np.uint64) * _BASE)

    def _sums(self, body: np.ndarray, first: int, last: int) -> np.ndarray:
        starts = self.starts[first:last] - self.starts[first]
        place = np.arange(len(body)) - np.repeat(starts, np.diff(np.append(starts, len(body))))
        value = _BYTE[body] * _POW[place & (_ROW - 1)]
        if (longest := int((self.ends[first:last] - self.starts[first:last]).max())) > _ROW:
            rows = np.concatenate([[np.uint64(1)], np.full(longest // _ROW + 1, _ROW_POW)]).astype(np.uint64)
            value *= rows.cumprod(dtype=np.uint64)[np.minimum(place // _ROW, longest // _ROW)]
        return np.add.reduceat(value, starts)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def word(self, k: int) -> bytes:
        return self.buffer[self.starts[k] : self.ends[k]]


def encode(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """(first, last) slices of whole texts of about ``limit`` bytes; a longer text stands alone."""
    first = size = 0
    for k, text in enumerate(texts):
        if k > first and size + len(text) > limit:
            yield first, k
            first, size = k, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def factors(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def grams(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of every run of ``size`` words; the caller drops runs that leave their text."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k, factor in enumerate(factors(size, seed)):
        total += hashes[k : k + count] * factor
    return mix(total)


def ragged(flat: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a packed list of arrays in the order of ``index``, and where each one ends."""
    starts = np.cumsum(sizes) - sizes
    count = sizes[index]
    ends = np.cumsum(count)
    place = np.arange(ends[-1] if len(ends) else 0)
    place += np.repeat(starts[index] - (ends - count), count)
    return flat[place], ends

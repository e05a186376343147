"""Words of whole texts as arrays: the building block of every operator of this subpackage.

A word is a maximal run of bytes other than space and 0x09-0x0D. Texts are read from Arrow buffers in slices of bounded
size (one document at least), so the memory of a task does not depend on its number of rows. Nulls and empty texts have no word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of a fixed odd number modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([[np.uint64(1)], np.full(max(n, 256) - 1, _ODD)]).cumprod(dtype=np.uint64)
    return _powers[:n]


@dataclass
class Words:
    """Words of a slice of documents. Word i covers raw[start[i]:end[i]]; document d has words first[d] to first[d + 1]."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.counts())

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.concatenate([[0], size[:-1].cumsum()])
        inside = np.arange(int(size.sum())) - np.repeat(at, size)
        weighed = _BYTE[self.raw[inside + np.repeat(self.start, size)]]
        weighed *= powers(int(size.max()))[inside]
        return mix(np.add.reduceat(weighed, at) ^ size.astype(np.uint64))

    def text(self, i: int) -> str:
        return self.raw[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or one row."""
    sizes = pa.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = sizes.cumsum()
    low = 0
    while low < len(sizes):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + limit, side="right"))
        yield low, (low := max(high, low + 1))


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more entry than rows). Nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, fold: bool = True) -> Words:
    """Words of every text; ``fold`` lower-cases A-Z."""
    raw, offsets = raw_texts(column)
    solid = ~_SPACE[raw]
    # A document's border ends a word, too: positions where a run begins or ends, or a text begins inside a run.
    change = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    start, end = change[::2], change[1::2]
    border = np.unique(offsets[1:-1])
    border = border[(border > 0) & (border < len(raw))]
    border = border[solid[border] & solid[border - 1]] if len(border) else border
    if len(border):
        start, end = np.sort(np.concatenate([start, border])), np.sort(np.concatenate([end, border]))
    first = np.searchsorted(start, offsets, side="left")
    first[-1] = len(start)
    return Words(_FOLD[raw] if fold else raw, start, end, first)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive words; entry i begins at word i, across document borders."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    out = hashes[:size].copy()
    for i in range(1, n):
        out *= _ODD
        out += hashes[i : i + size]
    return mix(out)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``n`` words, hashed and sorted in each document; a shorter text is one run as a whole.

    Returns the hashes and where each document's begin (one more entry than documents).
    """
    h = w.hashes()
    runs = grams(h, n)
    sets = []
    for low, high in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if high - low >= n:
            own = np.sort(runs[low : high - n + 1])
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            sets.append(own[fresh])
        elif high > low:
            value = np.full(1, high - low, np.uint64)
            for x in h[low:high]:
                value = mix(value * _ODD + x)
            sets.append(value)
        else:
            sets.append(runs[:0])
    return (np.concatenate(sets) if sets else runs[:0]), np.concatenate([[0], np.cumsum([len(x) for x in sets], dtype=np.int64)])

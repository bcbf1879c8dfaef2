"""Vectorised words, hashes and word n-grams over Arrow string columns.

A whole Arrow batch is handled as one byte array, so that no Python code runs
per word or per document.  A word is a maximal run of letters, digits and
non-ASCII bytes of the lower-cased text; its hash depends on its bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, unless one document is longer.
CHUNK_BYTES = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, r in enumerate((_R, _R_INV)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over the others."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def strings(col) -> pa.Array:
    """The column as one string array with nulls as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.string():
        col = col.cast(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and where each text begins (with a last end)."""
    if len(col) == 0 or col.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(col: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes each, or one row."""
    _, off = raw(col)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, len(col))
        i = j


class Words:
    """Words of an array of texts: hash ``h``, byte span ``s``..``e`` in ``data``, row ``row``; ``first`` has where each row's words begin."""

    def __init__(self, col: pa.Array, table: np.ndarray = WORD, lower: bool = True):
        self.data, self.off = raw(pc.utf8_lower(col) if lower else col)
        n = len(self.data)
        inside = table[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.s = np.flatnonzero(begins)
        self.e = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.s, self.off)
        self.row = np.repeat(np.arange(len(col)), np.diff(self.first))
        power, inverse = _grow(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self._sums[1:])
        self._inverse = inverse
        self.h = mix((self._sums[self.e] - self._sums[self.s]) * inverse[self.s])

    def stems(self, n: int, least: int) -> np.ndarray:
        """Hashes of the first n bytes of the words of at least so many bytes, and zeros for the rest."""
        end = np.minimum(self.s + n, self.e)
        h = mix(~((self._sums[end] - self._sums[self.s]) * self._inverse[self.s]))
        return np.where(self.e - self.s >= least, h, np.uint64(0))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of n words within a row, and the index of the first word of each."""
        count = len(self.h) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        g = np.zeros(count, np.uint64)
        for k in range(n):
            g *= np.uint64(_R)
            g += self.h[k : k + count]
        at = np.flatnonzero(self.row[:count] == self.row[n - 1 :])
        return mix(g[at]), at


def pieces(col) -> Iterator[tuple[int, int, Words]]:
    """Words of the whole column, by ranges of rows i..j of bounded size."""
    col = strings(col)
    for i, j in slices(col):
        yield i, j, Words(col.slice(i, j - i))

"""Words, hashes and word n-grams of many texts at once, in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text
(``[^\\x20\\x09-\\x0D]+``).  Hashes are 64-bit: a polynomial over random byte
values, modulo 2**64 and mixed.  All functions take whole texts; `pieces` only
bounds how many rows are worked on together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE_BYTES = 2_000_000
_BASE, _WORD_BASE, _SECOND_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of base and of its inverse modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if size <= 1 << 23:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; one long text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each of many ascending, disjoint spans."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + (1 << 18), "right")))
        a, b = start[i], end[j - 1]
        up, down = _pow(_BASE, b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * up[:-1], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out)


class Words:
    """The words of some texts: `start`, `end` (bytes), `row` and `hash` of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True, gaps: np.ndarray = _SPACE):
        """gaps: which bytes are no part of a word."""
        self.rows = len(offsets) - 1
        word = np.empty(len(data) + 2, bool)
        word[0] = word[-1] = False
        np.logical_not(gaps[data], out=word[1:-1])
        body, edge = word[1:-1], np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(body & (~word[:-2] | edge[:-1]))
        self.end = np.flatnonzero(body & (~word[2:] | edge[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.count = np.bincount(self.row, minlength=self.rows)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.data = _LOWER[data] if lower else data
        if hashes:
            self.hash = span_hash(self.data, self.start, self.end)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of every run of n words of one row."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:m] == self.row[n - 1 :])
        up, down = _pow(_WORD_BASE, len(self.hash) + 1)
        total = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up[:-1], out=total[1:])
        return at, mix((total[at + n] - total[at]) * down[at] + U(n))

    def again(self, at: np.ndarray, n: int) -> np.ndarray:
        """A second hash, independent of the first, of the runs of n words that start at `at`."""
        if not len(at):
            return np.zeros(0, np.uint64)
        up, down = _pow(_SECOND_BASE, len(self.hash) + 1)
        total = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(mix(self.hash ^ U(_BASE)) * up[:-1], out=total[1:])
        return mix((total[at + n] - total[at]) * down[at] + U(n))

    def whole(self, rows: np.ndarray) -> np.ndarray:
        """Hash of the whole word sequence of rows of fewer words than a window."""
        up, down = _pow(_WORD_BASE, len(self.hash) + 1)
        total = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * up[:-1], out=total[1:])
        a, b = self.first[rows], self.first[rows + 1]
        return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))

"""Vectorised tokenising and hashing of whole Arrow batches of text with numpy.

Words are maximal runs of bytes other than the six ASCII white-space characters, so no word crosses a
document and multi-byte characters stay whole. A word's hash is a polynomial over its bytes, taken as a
difference of prefix sums modulo 2**64, then mixed; cost per byte is constant, whatever the text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text handled at a time; a longer document is handled alone.
STEP = 1 << 20

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def numbers(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


class Hasher:
    """Word hashes of one family; families with different seeds are independent."""

    def __init__(self, seed: int = 1, lower: bool = False):
        self.table = numbers(seed, 256)
        if lower:
            self.table[65:91] = self.table[97:123]
        self.base = int(numbers(seed + 1000, 1)[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n + n // 8, STEP + 1)
            for name, base in (("up", self.base), ("down", self.inverse)):
                p = np.full(n, base, _U)
                p[0] = 1
                np.multiply.accumulate(p, out=p)
                setattr(self, name, p)

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(buf)
        self._powers(n + 1)
        sums = np.zeros(n + 1, _U)
        np.cumsum(self.table[buf] * self.up[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each value's offsets in them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def steps(offsets: np.ndarray, size: int = STEP, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes together, ``most`` documents at most."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, n, i + (most or n))
        yield i, j
        i = j


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each document's first word (one more at the end)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACES[buf]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ngrams(h: np.ndarray, first: np.ndarray, n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside documents, and each document's first window (one more at the end)."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(count)])
    if not bounds[-1]:
        return np.zeros(0, _U), bounds
    g = np.zeros(len(h) - n + 1, _U)
    for j, m in enumerate(numbers(seed, n) | _U(1)):
        g += h[j : len(h) - n + 1 + j] * m
    return mix(g[positions(first[:-1], count)]), bounds


def positions(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begins[0], begins[0]+1, ... (counts[0] of them), then the same for the next."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    keep = counts > 0
    b, c = begins[keep].astype(np.int64), counts[keep].astype(np.int64)
    if not len(b):
        return np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(c)[:-1]])
    out[0] = b[0]
    out[at[1:]] = b[1:] - (b[:-1] + c[:-1] - 1)
    return np.cumsum(out)

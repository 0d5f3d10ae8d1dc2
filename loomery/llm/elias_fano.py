"""Elias-Fano coding of ascending lists: low bits side by side, high bits in unary, any value found without the others."""

from __future__ import annotations

import numpy as np

_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


def encode(values: np.ndarray, most: int) -> bytes:
    """An ascending list of numbers from 0 to ``most`` in about 2 + log2(most / len(values)) bits each."""
    n = len(values)
    width = max(0, (most // n).bit_length() - 1) if n else 0
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel()
    high = np.zeros(n + (most >> width) + 1, np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    return np.array([n, width], "<i8").tobytes() + np.packbits(low).tobytes() + np.packbits(high).tobytes()


class EliasFano:
    """An encoded list, for ``select``."""

    def __init__(self, data: bytes):
        self.n, self.width = (int(x) for x in np.frombuffer(data, "<i8", 2))
        split = 16 + (self.n * self.width + 7) // 8
        self.low = np.frombuffer(data, np.uint8, split - 16, 16)
        self.high = np.frombuffer(data, np.uint8, -1, split)
        self.before = np.cumsum(_ONES[self.high])

    def __len__(self) -> int:
        return self.n

    def select(self, places: np.ndarray) -> np.ndarray:
        """The values at these places of the list."""
        byte = np.searchsorted(self.before, places, "right")
        bits = np.unpackbits(self.high[byte][:, None], axis=1)
        rest = places - (self.before[byte] - _ONES[self.high[byte]])
        bit = (np.cumsum(bits, axis=1) <= rest[:, None]).sum(axis=1)
        value = byte * 8 + bit - places << self.width
        for k in range(self.width):
            at = places * self.width + k
            value |= ((self.low[at >> 3] >> (7 - (at & 7))) & 1).astype(np.int64) << k
        return value

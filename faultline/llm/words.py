"""Words of an Arrow text column as numpy arrays, found and hashed without a loop over words.

A word is a maximal run of kept bytes; the usual class is everything but space and the controls 09-0D.
Multi-byte characters consist of bytes from 80 on, so they are never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[ord("A") : ord("Z") + 1] += 32
#: Everything but letters, digits and multi-byte characters.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_RATIO = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_RATIO))


_grown: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the ratio and of its inverse; a task keeps the longest it has needed."""
    if n > len(_grown[0]):
        size = (n + (1 << 18)) >> 18 << 18
        for i, x in enumerate((_RATIO, pow(_RATIO, -1, 1 << 64))):
            steps = np.full(size, x, dtype=np.uint64)
            steps[0] = 1
            _grown[i] = np.cumprod(steps, dtype=np.uint64)
    return _grown[0][:n], _grown[1][:n]


def forget() -> None:
    """Let go of the powers, which a later task of other steps may not need."""
    _grown[:] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """starts, ends: byte places in data; first: for each row the number of its first word, and the end; key: hashes."""

    def __init__(self, column: pa.Array, apart: np.ndarray = SPACE, alike: np.ndarray = SAME, keyed: bool = True):
        self.data, self.offsets = utf8(column)
        n = len(self.data)
        gap = apart[self.data]
        begins, ends = np.ones(n + 1, bool), np.ones(n + 1, bool)
        begins[1:] = gap
        ends[:n] = gap
        begins[self.offsets] = True
        ends[self.offsets] = True
        self.starts = np.flatnonzero(begins[:n] & ~gap)
        self.ends = np.flatnonzero(ends[1:] & ~gap) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.count = np.diff(self.first)
        self.key = self.hashed(alike) if keyed else None

    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashed(self, alike: np.ndarray = SAME) -> np.ndarray:
        """64-bit hashes of the words: a polynomial in the bytes, from prefix sums."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        n = len(self.data)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[alike[self.data]] * up[:n], out=self.sums[1:])
        return self.between(self.starts, self.ends)

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of stretches of bytes; equal to those of words with the same bytes."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial over all bytes, and the powers that shift it back."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    return total, down


def windows(key: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive keys; the result is shorter than key by width - 1."""
    n = len(key) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(_RATIO)
        out += key[j : j + n]
        out ^= out >> np.uint64(29)
    return mix(out)

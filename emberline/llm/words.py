"""Words of whole text columns as NumPy arrays: bounds and 64-bit hashes, without a Python loop over words.

Texts are read straight from Arrow's UTF-8 buffer. The word classes used here are stated over ASCII only, and every byte
of a longer UTF-8 sequence is a word byte in them, so working on bytes gives the same words as working on characters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

#: Words of alphanumerics and everything outside ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[ord("0"):ord("9") + 1] = ALNUM[ord("a"):ord("z") + 1] = ALNUM[0x80:] = True

#: Words of anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Powers are the product of one from a table of this many and one from a table of every so manieth.
_LOW_BITS = 12
_LOW = 1 << _LOW_BITS


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


@lru_cache(maxsize=1)
def _low_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, _LOW), _powers(_INVERSE, _LOW)


class Prefix:
    """Hashes of any slices of one buffer of numbers, each from two reads of a running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        blocks = (n >> _LOW_BITS) + 1
        up, self._down = _low_powers()
        high = _powers(pow(_BASE, _LOW, 1 << 64), blocks)
        self._high_down = _powers(pow(_INVERSE, _LOW, 1 << 64), blocks)
        worth = np.zeros(blocks << _LOW_BITS, dtype=np.uint64)
        worth[:n] = data
        worth[:n] += np.uint64(1)
        rows = worth.reshape(blocks, _LOW)
        rows *= up
        rows *= high[:, None]
        self._sum = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(worth[:n], out=self._sum[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        down = self._down[starts & (_LOW - 1)] * self._high_down[starts >> _LOW_BITS]
        return mix((self._sum[ends] - self._sum[starts]) * down + (ends - starts).astype(np.uint64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of a batch of texts in order; text ``i`` owns the words ``first[i]`` up to ``first[i + 1]``."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


#: Runs of alphanumerics (of either case) and runs of other visible characters.
RUNS = np.zeros(256, dtype=np.uint8)
RUNS[NOT_SPACE] = 2
RUNS[ALNUM] = RUNS[ord("A"):ord("Z") + 1] = 1


def words(column: pa.Array, kind: np.ndarray, lower: bool = True) -> Words:
    """Words of each text, after lower-casing A-Z if so told: the longest runs of bytes with one non-zero ``kind``."""
    data, offsets = utf8(column)
    data = LOWER[data] if lower else data
    kinds = kind[data]
    inside = kinds != 0
    n = len(data)
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:] = kinds[1:] == kinds[:-1]
    after[:-1] = before[1:]
    edge = offsets[:-1][offsets[:-1] < n]
    before[edge] = False
    after[edge[edge > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    return Words(Prefix(data).slices(starts, ends), first, starts, ends)

"""SuperMinHash signatures of word-shingle sets, computed for all texts of a batch together.

Every element walks through the slots in an order of its own (a keyed permutation) and offers slot number ``p(j)`` the
value ``j + r_j`` with a fraction drawn from element and rank; a slot keeps the least value. Ranks are correlated across
slots, as each element visits each slot once, which lowers the variance against independent hashes. Values of rank j
lie below those of rank j + 1, so a text whose slots are all taken after rank j needs no further ranks: texts leave the
loop early, large sets after a rank or two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import NOT_SPACE, mix, words

SLOTS = 128
#: Slots of a band; texts with an equal band are candidates.
ROWS = 4
BANDS = SLOTS // ROWS


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in rising order, and where each text's begin; short texts are one shingle."""
    found = words(texts, NOT_SPACE)
    counts, hashes = found.counts, found.hashes
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    start = np.repeat(found.first[:-1] - first[:-1], n) + np.arange(first[-1])
    length = np.repeat(np.minimum(counts, size), n)
    value = length.astype(np.uint64)
    for i in range(size):
        take = i < length
        value[take] = mix(value[take] * np.uint64(0x9E3779B97F4A7C15) + hashes[start[take] + i])
    text = np.repeat(np.arange(len(n)), n)
    order = np.argsort(value)
    order = order[np.argsort(text[order].astype(np.uint16) if len(n) < 1 << 16 else text[order], kind="stable")]
    value, text = value[order], text[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(n) + 1))


def place(key: np.ndarray, rank: int) -> np.ndarray:
    """The slot that comes at ``rank`` in each element's own order of the slots (a permutation of 0..127 per key)."""
    mask = np.uint64(SLOTS - 1)
    x = (np.uint64(rank) * ((key << np.uint64(1)) | np.uint64(1)) + (key >> np.uint64(7))) & mask
    x ^= x >> np.uint64(3)
    x = (x * ((key >> np.uint64(13)) | np.uint64(1)) + (key >> np.uint64(21))) & mask
    x ^= x >> np.uint64(4)
    return (x * ((key >> np.uint64(27)) | np.uint64(1)) + (key >> np.uint64(35))) & mask


def signatures(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of ``SLOTS`` values a text: rank in the upper bits, 24 bits of fraction below. Empty sets keep the maximum."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    out = np.full((n, SLOTS), np.iinfo(np.uint32).max, dtype=np.uint32)
    flat = out.reshape(-1)
    for rank in range(SLOTS):
        if not len(elements):
            break
        draw = mix(elements + np.uint64((rank + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        slot = place(elements, rank).astype(np.int64)
        np.minimum.at(flat, text * SLOTS + slot, (np.uint32(rank << 24) | (draw >> np.uint64(40)).astype(np.uint32)))
        if rank < 2 or rank % 4 == 3:  # looking costs about as much as a rank
            open_ = (out == np.iinfo(np.uint32).max).any(axis=1)
            stay = open_[text]
            if not stay.all():
                elements, text = elements[stay], text[stay]
    return out


def short(signature: np.ndarray) -> np.ndarray:
    """16 bits of each slot: what is stored and compared; unlike values agree once in 65,536 times."""
    return (signature & np.uint32(0xFFFF)).astype("<u2")


def bands(signature: np.ndarray) -> np.ndarray:
    """The bucket of each band of short signatures."""
    value = np.ascontiguousarray(signature).reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.arange(BANDS, dtype=np.uint64)[None, :].repeat(len(signature), 0)
    for i in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + value[:, :, i])
    return out.view(np.int64)

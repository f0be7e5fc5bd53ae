"""Document fingerprints from content-defined chunks.

A gear hash rolls over the bytes of a text. A chunk ends where its top bits are zero, with normalised chunking: a strict
mask before the normal size, a loose one after it, a smallest and a largest size. Inserting or deleting text therefore
moves boundaries only near the change. The fingerprint is the set of chunk digests with their lengths; containment
of A in B is the length of A's distinct chunks that B has too, over the length of all distinct chunks of A.

A 16-bit register makes the window 16 bytes, the smallest size, so no boundary depends on bytes before the text and
equal texts always have equal fingerprints.

Cases: a null or empty text has an empty fingerprint, is wholly like another empty one and unlike all else; a text below
the smallest size is one chunk; very long texts only have more chunks; repeated rows have equal fingerprints.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import with_columns
from .words import Prefix, mix, utf8

SMALLEST, NORMAL, LARGEST = 16, 32, 128
#: Top bits of the register that are zero at a boundary, before and after the normal size.
STRICT, LOOSE = 7, 3

GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", dtype=np.uint8)


def gear(data: np.ndarray) -> np.ndarray:
    """The register after each byte: h = 2h + GEAR[byte] mod 2^16, by doubling the window."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        h[width:] = h[width:] + (h[:-width] << np.uint16(width))
    return h


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of the chunks of all texts; all texts advance by one chunk at a time."""
    h = gear(data) >> np.uint16(16 - STRICT)
    strict = np.append(np.flatnonzero(h == 0) + 1, len(data) + LARGEST)
    loose = np.append(np.flatnonzero(h >> np.uint16(STRICT - LOOSE) == 0) + 1, len(data) + LARGEST)
    text = np.flatnonzero(np.diff(offsets) > 0)
    at, stop = offsets[text], offsets[text + 1]
    starts, ends, owners = [], [], []
    while len(at):
        early = strict[np.searchsorted(strict, at + SMALLEST)]
        late = np.minimum(loose[np.searchsorted(loose, at + NORMAL)], at + LARGEST)
        end = np.minimum(np.where(early < at + NORMAL, early, late), stop)
        starts.append(at)
        ends.append(end)
        owners.append(text)
        going = end < stop
        at, stop, text = end[going], stop[going], text[going]
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(owners)


@dataclass
class Sets:
    """Distinct chunks of each text, ordered by text and key; a key is 48 bits of digest and 12 of length."""

    n: int
    text: np.ndarray
    key: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Sets:
        data, offsets = utf8(texts)
        starts, ends, text = cut(data, offsets)
        key = (Prefix(data).slices(starts, ends) >> np.uint64(16) << np.uint64(12)) | (ends - starts).astype(np.uint64)
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        return cls(len(texts), text[new], key[new])

    def weight(self, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount(self.text[some], (self.key[some] & np.uint64(4095)).astype(float), self.n)

    def strings(self) -> pa.Array:
        """Ten letters of 6 bits for each chunk, in order of the keys."""
        shifts = np.arange(54, -1, -6, dtype=np.uint64)
        letters = _LETTERS[(self.key[:, None] >> shifts & np.uint64(63)).astype(np.intp)]
        offsets = np.searchsorted(self.text, np.arange(self.n + 1)) * 10
        return pa.LargeStringArray.from_buffers(self.n, pa.py_buffer(offsets.astype(np.int64)),
                                                pa.py_buffer(np.ascontiguousarray(letters)))

    def contained(self, other: Sets) -> np.ndarray:
        """Per text, the share of its chunks' length that the same text of ``other`` has; of an empty text, all."""
        text, key = np.concatenate([self.text, other.text]), np.concatenate([self.key, other.key])
        order = np.lexsort((key, text))
        text, key = text[order], key[order]
        twice = np.zeros(len(key), dtype=bool)
        twice[1:] = (key[1:] == key[:-1]) & (text[1:] == text[:-1])
        common = np.bincount(text[twice], (key[twice] & np.uint64(4095)).astype(float), self.n)
        whole = self.weight()
        return np.where(whole > 0, common / np.maximum(whole, 1), 1.0)

    def likeness(self, other: Sets) -> np.ndarray:
        """The lesser of the two containments: near 1 only where each text holds most of the other."""
        return np.minimum(self.contained(other), other.contained(self))


def fingerprint(df: DataFrame, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of ``text``."""
    return with_columns(df, [text], [T.StructField(fingerprint, T.StringType())], lambda: lambda t: (Sets.of(t).strings(),))


def compare(df: DataFrame, text: str, others: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Adds the fingerprint of ``text``, and per other text column (fingerprint, containment, likeness) by these names."""
    adds = [T.StructField("fingerprint", T.StringType())]
    for a, b, c in others.values():
        adds += [T.StructField(a, T.StringType()), T.StructField(b, T.DoubleType()), T.StructField(c, T.DoubleType())]

    def run(own: pa.Array, *columns: pa.Array):
        mine = Sets.of(own)
        out = [mine.strings()]
        for column in columns:
            theirs = Sets.of(column)
            out += [theirs.strings(), pa.array(mine.contained(theirs)), pa.array(mine.likeness(theirs))]
        return out

    return with_columns(df, [text, *others], adds, lambda: run, drop=[text, *others])

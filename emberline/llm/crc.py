"""CRC-32 of many byte strings at once, and of joined strings from the registers of their parts.

The checksum's register is linear: starting from zero, the register of ``a + b`` is that of ``a``, moved on by as many zero
bytes as ``b`` has, xor that of ``b``. So words are read byte by byte only once, all words of a batch in step, and n-grams
follow from the registers and lengths of their words.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

# Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320

#: Byte strings up to this length are read in step; longer ones one by one.
LONG = 48
#: Moves by up to so many bytes are looked up whole.
NEAR = 64

_U = np.uint32


@lru_cache(maxsize=1)
def step_table() -> np.ndarray:
    table = np.arange(256, dtype=_U)
    for _ in range(8):
        table = np.where(table & _U(1), (table >> _U(1)) ^ _U(POLYNOMIAL), table >> _U(1))
    return table


def _move_once(x: np.ndarray) -> np.ndarray:
    return step_table()[x & _U(255)] ^ (x >> _U(8))


@lru_cache(maxsize=1)
def near_moves() -> np.ndarray:
    """For each number of bytes up to ``NEAR`` and each of the register's four bytes, where that byte's values are moved to."""
    out = np.zeros((NEAR + 1, 4, 256), dtype=_U)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=_U) << _U(8 * k)
    for n in range(1, NEAR + 1):
        out[n] = _move_once(out[n - 1])
    return out.reshape(-1)


@lru_cache(maxsize=64)
def far_move(power: int) -> np.ndarray:
    """The same for two to the ``power`` bytes."""
    at = np.zeros((4, 256), dtype=_U)
    for k in range(4):
        at[k] = np.arange(256, dtype=_U) << _U(8 * k)
    if power == 0:
        return _move_once(at)
    half = far_move(power - 1)
    return _look_up(half.reshape(-1), 0, _look_up(half.reshape(-1), 0, at.reshape(-1))).reshape(4, 256)


def _look_up(table: np.ndarray, base: np.ndarray | int, x: np.ndarray) -> np.ndarray:
    return (table[base + (x & _U(255))] ^ table[base + 256 + ((x >> _U(8)) & _U(255))]
            ^ table[base + 512 + ((x >> _U(16)) & _U(255))] ^ table[base + 768 + (x >> _U(24))])


def moved(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Registers ``x`` moved on by ``n`` zero bytes each."""
    if len(n) == 0 or n.max() <= NEAR:
        return _look_up(near_moves(), n.astype(np.int64) << 10, x)
    out, left, power = x.copy(), n.astype(np.int64), 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _look_up(far_move(power).reshape(-1), 0, out[odd])
        left >>= 1
        power += 1
    return out


def registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Registers, from zero, of slices of a byte array."""
    n = ends - starts
    order = np.argsort(np.minimum(n, LONG + 1).astype(np.uint8), kind="stable")[::-1]
    sizes, places = n[order], starts[order]
    out = np.zeros(len(n), dtype=_U)
    table = step_table()
    first = int(np.searchsorted(-sizes, -LONG))  # those longer than LONG lead
    held = np.zeros(len(n), dtype=_U)
    for i in range(first):
        slice_ = data[places[i]:places[i] + sizes[i]]
        held[i] = np.uint32(zlib.crc32(slice_.tobytes()) ^ 0xFFFFFFFF)
    if first:
        held[:first] ^= moved(np.full(first, 0xFFFFFFFF, dtype=_U), sizes[:first])
    for p in range(int(sizes[first]) if first < len(sizes) else 0):
        upto = int(np.searchsorted(-sizes, -p))  # those longer than p
        c = held[first:upto]
        held[first:upto] = table[(c ^ data[places[first:upto] + p]) & _U(255)] ^ (c >> _U(8))
    out[order] = held
    return out


def checksum(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 of byte strings from their registers and lengths."""
    return register ^ moved(np.full(len(n), 0xFFFFFFFF, dtype=_U), n) ^ _U(0xFFFFFFFF)

"""Static binary fuse filters (three slots a key, one byte a slot), built and probed with NumPy.

A filter is built once over the distinct keys of an immutable set.  It never misses a key of the
set; about one foreign key in 256 passes by chance.  Layout: key hashes fall on three neighbouring
segments of a table of about 1.13 bytes a key; the table is filled by peeling, many keys a round.
"""

from __future__ import annotations

import math
import struct

import numpy as np

_U = np.uint64
_HEADER = "<QQQ"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit keys (the finaliser of MurmurHash3)."""
    h = keys + _U(seed)
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _shape(keys: int) -> tuple[int, int]:
    """Segment length and number of first-slot segments for a three-way filter."""
    if keys < 2:
        return 4, 1
    length = min(1 << int(math.floor(math.log(keys) / math.log(3.33) + 2.25)), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(keys))
    return length, max(1, -(-int(round(keys * factor)) // length) - 2)


def _slots(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    first = ((h >> _U(32)) * _U(segments * length)) >> _U(32)
    mask = _U(length - 1)
    return np.stack([first, (first + _U(length)) ^ ((h >> _U(18)) & mask), (first + _U(2 * length)) ^ (h & mask)]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> _U(32))) & _U(255)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """Filter over unsigned 64-bit ``keys``; repeats count once."""
    keys = np.unique(np.asarray(keys, dtype=np.uint64))
    length, segments = _shape(len(keys))
    for seed in range(1, 1000):
        if seed % 10 == 0:  # very small sets may need room
            segments += 1
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        slots, size = _slots(h, length, segments), (segments + 2) * length
        count = np.bincount(slots.ravel(), minlength=size)
        # the sum of key numbers on a slot names the key once it is the only one left
        total = np.zeros(size, dtype=np.int64)
        for row in slots:
            np.add.at(total, row, np.arange(len(keys)))
        order, alone = [], np.flatnonzero(count == 1)
        while len(alone):
            key, first = np.unique(total[alone], return_index=True)
            own = alone[first]
            order.append((key, own))
            touched = slots[:, key]
            np.subtract.at(count, touched.ravel(), 1)
            np.subtract.at(total, touched.ravel(), np.tile(key, 3))
            near = np.unique(touched)
            alone = near[count[near] == 1]
        if sum(len(k) for k, _ in order) == len(keys):
            table, prints = np.zeros(size, dtype=np.uint8), _prints(h)
            for key, own in reversed(order):
                table[own] = 0
                a, b, c = table[slots[:, key]]
                table[own] = prints[key] ^ a ^ b ^ c
            return struct.pack(_HEADER, seed, length, segments) + table.tobytes()
    raise RuntimeError("no seed gives a filter")


def contains(data: bytes, keys: np.ndarray) -> np.ndarray:
    """For each key whether the filter lets it pass."""
    seed, length, segments = struct.unpack_from(_HEADER, data)
    table = np.frombuffer(data, dtype=np.uint8, offset=struct.calcsize(_HEADER))
    h = _mix(np.asarray(keys, dtype=np.uint64), seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    a, b, c = table[_slots(h, length, segments)]
    return (a ^ b ^ c) == _prints(h)

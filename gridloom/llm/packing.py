"""Compact binary forms of integer arrays, for what is shuffled in bulk."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa


def pack_ints(values: np.ndarray) -> bytes:
    """Any non-negative integers, by byte plane."""
    planes = np.ascontiguousarray(values, dtype=np.uint64).view(np.uint8).reshape(-1, 8).T
    wide = 8
    while wide > 1 and not planes[wide - 1].any():
        wide -= 1
    return struct.pack("<qb", len(values), wide) + pa.compress(planes[:wide].tobytes(), "zstd", asbytes=True)


def unpack_ints(raw: bytes) -> np.ndarray:
    n, wide = struct.unpack_from("<qb", raw)
    planes = np.zeros((8, n), dtype=np.uint8)
    planes[:wide] = np.frombuffer(pa.decompress(raw[9:], n * wide, "zstd", asbytes=True), dtype=np.uint8).reshape(wide, n)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted non-negative integers, as differences."""
    values = np.asarray(values, dtype=np.uint64)
    return pack_ints(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(raw), dtype=np.uint64)

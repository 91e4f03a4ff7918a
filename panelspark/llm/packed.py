"""Arrays of numbers as compressed binary cells, for blocks that travel between tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def squeeze(array: np.ndarray) -> bytes:
    """Little-endian values as byte planes, compressed."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T
    raw = np.ascontiguousarray(planes).tobytes()
    return np.int64([len(raw), array.itemsize]).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def expand(blob: bytes, kind) -> np.ndarray:
    size, width = np.frombuffer(blob, np.int64, 2)
    raw = pa.decompress(blob[16:], decompressed_size=int(size), codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(int(width), -1).T
    stored = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[int(width)]
    return np.ascontiguousarray(planes).view(stored).reshape(-1).astype(kind, copy=False)


def small(array: np.ndarray) -> np.ndarray:
    """Non-negative numbers in the narrowest unsigned type."""
    top = int(array.max()) if len(array) else 0
    return array.astype(np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def range_edges(parts: int) -> np.ndarray:
    """First 64-bit hash of each of ``parts`` equal ranges."""
    width = (1 << 64) // parts + 1
    return np.array([min(p * width, (1 << 64) - 1) for p in range(parts)], np.uint64)

"""Words and word hashes of whole Arrow batches, in numpy.

A word is a run of bytes other than space and 0x09-0x0D, which never cuts a
UTF-8 code point. Hashes are polynomials over 2^64 (Rabin-Karp): a prefix sum over
a chunk gives the hash of any word in it at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Bytes of text worked on at a time; a longer text makes a chunk of its own.
CHUNK = 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the splitmix64 finisher)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def row(base):
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return row(BASE), row(_INVERSE)


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse for i up to ``length``, from a cached table."""
    size = CHUNK + 1
    while size <= length:
        size *= 2
    return _powers(size)


@dataclass
class Words:
    """Words of one chunk of texts.

    ``data`` holds the texts' bytes one after the other, text d at
    ``text[d]:text[d + 1]``; word i lies at ``start[i]:end[i]`` and the words of
    text d are ``first[d]:first[d + 1]``. ``row`` is the chunk's first row in the
    batch.
    """

    data: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    row: int

    @property
    def texts(self) -> int:
        return len(self.text) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """For each word its text's number in the chunk."""
        return np.repeat(np.arange(self.texts), self.counts)

    def hashes(self, table: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word; ``table`` maps bytes first (``LOWER``)."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.data))
        code = _BYTE if table is None else _BYTE[table]
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(code[self.data] * up[: len(self.data)], out=sums[1:])
        raw = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix(raw + (self.end - self.start).astype(np.uint64))


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[Words]:
    """The words of a string array, some ``limit`` bytes at a time; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(at, at[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), len(texts))
        yield _cut(data[at[row] : at[stop]], at[row : stop + 1] - at[row], row)
        row = stop


def _cut(data: np.ndarray, text: np.ndarray, row: int) -> Words:
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[text] = True
    start = np.flatnonzero(inside[1:] & (edge | ~inside[:-1]))
    end = np.flatnonzero(inside[:-1] & (edge | ~inside[1:]))
    return Words(data, text, start, end, np.searchsorted(start, text), row)


def windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every run of ``size`` words in one text.

    Returns the hashes and the number of each run's first word.
    """
    total = len(hashes) - size + 1
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rolled = hashes[:total].copy()
    for step in range(1, size):
        rolled *= BASE
        rolled += hashes[step : step + total]
    last = np.repeat(words.first[1:], words.counts)[:total]
    at = np.flatnonzero(np.arange(total) + size <= last)
    return mix(rolled[at]), at

"""Vectorised word and shingle hashing over UTF-8 buffers.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, after A-Z are
lower-cased; all other bytes count as they are.  A word's hash is a polynomial
over the ring of 64-bit integers, taken from prefix sums, so that a whole batch
is hashed with a dozen array operations and no loop over words.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed together; a longer document forms a chunk of its own.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed)) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


class WordHasher:
    """Hashes of the words of documents, chunk by chunk."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK + 1)
            self.up, self.down = powers(BASE, n), powers(BASE_INVERSE, n)
        return self.up, self.down

    def chunks(self, data: np.ndarray, offsets: np.ndarray):
        """Yields (first document, word hashes, word bounds of each document)."""
        first, n = 0, len(offsets) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
            yield first, *self.words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every word."""
        inside = (data != 32) & ((data < 9) | (data > 13))
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.concatenate(([False], inside[:-1])) & ~cut[:-1]
        after = np.concatenate((inside[1:], [False])) & ~cut[1:]
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        starts, ends = self.spans(data, offsets)
        up, down = self.tables(len(data) + 1)
        lower = data + (((data >= 65) & (data <= 90)) << 5).astype(np.uint8)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, bounds: np.ndarray, n: int):
    """The sorted distinct shingle hashes of each document of a chunk.

    A document of fewer than n words has its whole sequence as its only
    shingle; one without words has none.
    """
    c = constants(n, 5)
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        rolled += words[k : k + len(rolled)] * c[k]
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(rolled[a : b - n + 1])
        elif b > a:
            yield mix(np.array([(words[a:b] * c[: b - a]).sum(dtype=np.uint64) ^ np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(column, n: int, hasher: WordHasher):
    """The shingle sets of an Arrow string column, in order."""
    data, offsets = text_buffers(column)
    for _, words, bounds in hasher.chunks(data, offsets):
        yield from shingles(words, bounds, n)

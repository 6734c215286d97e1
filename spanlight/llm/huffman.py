"""Canonical Huffman codes of limited length, with table-driven decoding in blocks.

A block's bits can be entered at checkpoints, one for every STEP ids, so that a
block is decoded with one array operation for all checkpoints at a time.
"""

from __future__ import annotations

import numpy as np

#: Longest code in bits (longer only if there are more symbols than such codes).
LIMIT = 20
#: Ids between two checkpoints.
STEP = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The optimal code lengths up to a limit, by package-merge; 0 for symbols that don't occur."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    limit = max(limit, int(len(used) - 1).bit_length())
    leaves = used[np.lexsort((used, counts[used]))]
    weights = counts[leaves]
    level, levels = weights, [np.ones(len(weights), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weights, pairs))
        order = np.argsort(both, kind="stable")
        level = both[order]
        levels.append(order < len(weights))
    take = 2 * len(used) - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        out[leaves[:own]] += 1
        take = 2 * (take - own)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by rising (length, symbol)."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for size in range(1, int(lengths.max(initial=0)) + 1):
        code <<= size - last
        last = size
        own = order[lengths[order] == size]
        codes[own] = code + np.arange(len(own))
        code += len(own)
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, np.uint8)
        self.codes = canonical_codes(self.lengths)
        self.width = max(1, int(self.lengths.max(initial=0)))
        self.table = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits and the bit offsets of ids 0, STEP, 2 * STEP, ..."""
        size = self.lengths[ids].astype(np.int64)
        end = np.cumsum(size)
        start = end - size
        words = int(end[-1] + 63) // 32 + 1 if len(ids) else 1
        shifted = self.codes[ids] << (np.uint64(64) - (start & 31).astype(np.uint64) - size.astype(np.uint64))
        at = start >> 5
        # Codes share no bit, so sums are unions; each sum is below 2**32 and exact.
        total = np.bincount(at, (shifted >> np.uint64(32)).astype(float), words) + np.bincount(at + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(float), words)
        bits = total.astype(">u4").tobytes()
        return bits[: (int(end[-1]) + 7) // 8 if len(ids) else 0], start[::STEP]

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        if self.table is None:
            order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
            order = order[self.lengths[order] > 0]
            self.table = np.repeat(order.astype(np.int32), np.int64(1) << (self.width - self.lengths[order].astype(np.int64)))
            self.table = np.concatenate((self.table, np.zeros((1 << self.width) - len(self.table), np.int32)))
        data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint64)
        window = (data[:-4] << np.uint64(32)) | (data[1:-3] << np.uint64(24)) | (data[2:-2] << np.uint64(16)) | (data[3:-1] << np.uint64(8)) | data[4:]
        at, lanes = np.asarray(checkpoints, np.int64).copy(), len(checkpoints)
        out = np.zeros((lanes, STEP), np.int32)
        shift, mask = np.uint64(40 - self.width), np.uint64((1 << self.width) - 1)
        last = len(window) - 1
        for k in range(min(STEP, n)):
            here = np.minimum(at, last * 8)
            x = (window[here >> 3] >> (shift - (here & 7).astype(np.uint64))) & mask
            out[:, k] = got = self.table[x.astype(np.int64)]
            at += self.lengths[got]
        return out.ravel()[:n]

"""Pieces of many texts that lie in one buffer, each distinct one seen by Python once.

Where pieces meet is found by array operations and equal pieces by Arrow's
dictionary encoding, so what is done for a piece is done for the distinct ones
only; the results are then strung together by their places.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: What a byte is: an ASCII letter, an ASCII mark, the apostrophe, which may start a piece of letters, or anything else.
LETTER, MARK, APOSTROPHE = 1, 2, 3
KINDS = np.array([LETTER if chr(b).isalpha() else APOSTROPHE if b == 39 else MARK if 32 < b < 127 and not chr(b).isdigit() else 0 for b in range(128)] + [0] * 128, np.uint8)

#: White space of three bytes.
WIDE_WHITE = [int.from_bytes(chr(c).encode()) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def letters_meet_marks(data: np.ndarray) -> np.ndarray:
    """True where a piece of UTF-8 may start, as a mark follows a letter or a letter a mark.

    The patterns of the tokenizers here take no letters and marks into one
    piece, but for an apostrophe and letters after it.  Letters are those of
    ASCII and, before a mark, those from U+00C0 to U+00FF.
    """
    kinds = KINDS.take(data)
    first = np.zeros(len(data), bool)
    if len(data) > 1:
        ends = kinds[:-1] == LETTER
        lead = np.flatnonzero(data[:-2] == 0xC3) + 1
        ends[lead] = (data[lead] != 0x97) & (data[lead] != 0xB7)  # not the signs for times and divided
        first[1:] = (ends & (kinds[1:] >= MARK)) | ((kinds[:-1] == MARK) & (kinds[1:] == LETTER))
    return first


def white_ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where UTF-8 has white space of ASCII, and where any Unicode white space has its last byte."""
    ascii_white = (data == 32) | ((data >= 9) & (data <= 13))
    white = ascii_white.copy()
    at = np.flatnonzero(data == 0xC2) + 1
    white[at] = (data[at] == 0x85) | (data[at] == 0xA0)
    at = np.flatnonzero((data >= 0xE1) & (data <= 0xE3))
    if len(at):
        white[at + 2] = np.isin(data[at].astype(np.int32) << 16 | data[at + 1].astype(np.int32) << 8 | data[at + 2], WIDE_WHITE)
    return ascii_white, white


def distinct(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Which of the distinct pieces each piece is, and those; pieces start at ``starts``, the first at 0."""
    ends = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def strung(which: np.ndarray, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit ids of all pieces, and where each piece's ids end; ``ids`` are those of the distinct ones."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), np.int32)
    n = sizes.take(which)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat.take(np.repeat(starts.take(which) - ends + n, n) + np.arange(total)), ends

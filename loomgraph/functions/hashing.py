"""MD5 of runs of tokens, many at a time: a call for each costs several times its work."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa

#: Runs that are hashed at once, and the longest that fit one block of MD5.
_AT_ONCE, _ONE_BLOCK = 1 << 12, 55
#: What of a block a run of each size fills, and its padding.
_FILLED = np.where(np.arange(64) < np.arange(_ONE_BLOCK + 1)[:, None], 0xFF, 0).astype(np.uint8)
_PADDING = np.where(np.arange(64) == np.arange(_ONE_BLOCK + 1)[:, None], 0x80, 0).astype(np.uint8)
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) & 0xFFFFFFFF for i in range(64)]
_FIRST = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _one_block(text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the MD5 of short runs of a text, as numbers."""
    m = np.lib.stride_tricks.sliding_window_view(text, 64)[begin]
    m &= _FILLED[size]
    m |= _PADDING[size]
    words = np.ascontiguousarray(m.view("<u4").T)
    words[14] = size * 8
    a, b, c, d = (np.full(len(m), x, np.uint32) for x in _FIRST)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[g]
        f += np.uint32(_SINES[i])
        a, d, c = d, c, b
        b = b + ((f << np.uint32(_SHIFTS[i])) | (f >> np.uint32(32 - _SHIFTS[i])))
    swapped = [(x + np.uint32(y)).byteswap().astype(np.uint64) for x, y in ((a, _FIRST[0]), (b, _FIRST[1]))]
    return (swapped[0] << np.uint64(32)) | swapped[1]


def _digest(run: bytes) -> int:
    return int.from_bytes(hashlib.md5(run, usedforsecurity=False).digest()[:8], "big")


def runs_hashed(lists: pa.ListArray, run: int) -> list[np.ndarray]:
    """For each list of tokens the first 8 bytes of the MD5 of all its runs of so many tokens, joined by the unit separator, as unsigned numbers in their order. A null token is left out of its runs."""
    counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    tokens = lists.flatten()
    each = np.maximum(counts - run + 1, 0)
    if tokens.null_count:
        rows = ((x or [], n) for x, n in zip(lists.to_pylist(), each.tolist()))
        return [np.array([_digest(chr(31).join(w for w in x[i : i + run] if w is not None).encode()) for i in range(n)], np.uint64) for x, n in rows]
    size = tokens.cast(pa.large_binary())
    ends = np.frombuffer(size.buffers()[1], np.int64, len(size) + 1, size.offset * 8)
    data = np.frombuffer(size.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(size) and ends[-1] > ends[0] else np.empty(0, np.uint8)
    lengths = np.diff(ends)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    text = np.full(starts[-1] + 64, 31, np.uint8)
    text[np.arange(len(data)) + np.repeat(np.arange(len(lengths)), lengths)] = data
    firsts = np.cumsum(counts) - counts
    token = np.repeat(firsts - (np.cumsum(each) - each), each) + np.arange(each.sum())
    begin, length = starts[token], starts[token + run] - 1 - starts[token]
    out = np.empty(len(token), np.uint64)
    short = np.flatnonzero(length <= _ONE_BLOCK)
    for i in range(0, len(short), _AT_ONCE):
        some = short[i : i + _AT_ONCE]
        out[some] = _one_block(text, begin[some], length[some])
    whole = text.tobytes()
    for i in np.flatnonzero(length > _ONE_BLOCK).tolist():
        out[i] = _digest(whole[begin[i] : begin[i] + length[i]])
    return np.split(out, np.cumsum(each)[:-1]) if len(each) else []

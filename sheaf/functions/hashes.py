"""The first digits of MD5 for many short texts at once, inside a task."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

# Longer texts take more than one block of MD5 and go one by one.
ONE_BLOCK = 55
CHUNK_ROWS = 32_768
_SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().astype(np.uint32)
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint64).astype(np.uint32)
_WORDS = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, 7 * i % 16)[i // 16] for i in range(64)]
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def _block_heads(words: list[np.ndarray | None], constants: np.ndarray) -> np.ndarray:
    """First word of the MD5 of blocks of 16 words: those of each column (None: all 0) with the bits of each row of constants."""
    sizes = len(constants), max(len(w) for w in words if w is not None) if any(w is not None for w in words) else 1
    own = {g: w | constants[:, g, None] for g, w in enumerate(words) if w is not None}
    added = [_SINES[i] + (constants[:, g, None] if g not in own else np.uint32(0)) for i, g in enumerate(_WORDS)]
    a, b, c, d = (np.full(sizes, x) for x in _START)
    f, turned = np.empty((2, *sizes), np.uint32)
    # The steps behind these do not change the first word.
    for i, g in enumerate(_WORDS[:61]):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        f += added[i]
        if g in own:
            f += own[g]
        np.left_shift(f, _SHIFTS[i], out=turned)
        f >>= _SHIFTS[i].dtype.type(32 - int(_SHIFTS[i]))
        turned |= f
        turned += b
        a, b, c, d, turned = d, turned, b, c, a
    return (b + _START[0]).byteswap()


def md5_heads(names: pa.Array, tails: list[str]) -> np.ndarray:
    """First 32 bits of the MD5 of every name followed by every tail: a row for each name, a column for each tail.

    Names of one length are hashed together: a tail then falls on the same bytes of all.
    """
    ends = [t.encode() for t in tails]
    out = np.empty((len(ends), len(names)), np.uint32)
    texts = names.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8) if len(texts) else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    for length in np.unique(lengths):
        same = np.flatnonzero(lengths == length)
        for first in range(0, len(same), CHUNK_ROWS):
            some = same[first : first + CHUNK_ROWS]
            if length <= ONE_BLOCK:
                blocks = np.zeros((len(some), 64), np.uint8)
                blocks[:, :length] = data[offsets[some][:, None] + np.arange(length)]
                words = [np.ascontiguousarray(w) if 4 * g < length else None for g, w in enumerate(blocks.view("<u4").T)]
            fits = [k for k, end in enumerate(ends) if length + len(end) <= ONE_BLOCK]
            step = max(1, CHUNK_ROWS // len(some))
            for part in (fits[i : i + step] for i in range(0, len(fits), step)):
                rest = np.zeros((len(part), 64), np.uint8)
                for row, k in zip(rest, part, strict=True):
                    row[length : length + len(ends[k]) + 1] = np.frombuffer(ends[k] + b"\x80", np.uint8)
                constants = rest.view("<u4")
                constants[:, 14] = [8 * (length + len(ends[k])) for k in part]
                out[np.array(part)[:, None], some] = _block_heads(words, constants)
            for k in set(range(len(ends))).difference(fits):
                whole = (data[offsets[i] : offsets[i + 1]].tobytes() + ends[k] for i in some)
                out[k, some] = [int(hashlib.md5(x).hexdigest()[:8], 16) for x in whole]
    return out.T

"""Arrow batches of texts: byte views, bounded chunks, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
# Positions in a word with a table row of their own; later ones are told apart
# by an odd factor.
POSITIONS = 64
CHUNK_BYTES = 1 << 20


def texts(column: pa.Array) -> list[str]:
    """Strings of a text column; null is the empty text."""
    return ["" if v is None else v for v in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and its offsets, from 0; null is the empty text."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes each; one row may hold more."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def random_table(seed: int, *shape: int) -> np.ndarray:
    """Pseudo-random 64-bit values, the same in every process."""
    n = int(np.prod(shape))
    steps = np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(0x100000001)
    return mix(steps * U64(0x9E3779B97F4A7C15)).reshape(shape)


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUES = {seed: random_table(seed, POSITIONS, 256) for seed in (1, 2)}


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row bounds of the words ``[^\\x20\\x09-\\x0D]+``.

    Row ``r`` holds words ``bounds[r]`` to ``bounds[r + 1]``; a word never
    reaches into the next row.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    opens[at] = inside[at]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word, by a random value for each byte and place."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    letters = data[place + np.repeat(starts, lengths)].astype(np.int64)
    values = _BYTE_VALUES[seed].ravel()[((place & (POSITIONS - 1)) << 8) + letters]
    if lengths.max() > POSITIONS:
        values = values * (U64(2) * (place // POSITIONS).astype(U64) + U64(1))
    return mix(np.add.reduceat(values, first) + lengths.astype(U64))


def window_hashes(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of each run of ``size`` values, by doubling.

    Runs that reach over the end of the array are not returned.
    """
    if len(hashes) < size:
        return np.zeros(0, U64)
    # 3 modulo 8: swapping neighbours loses one bit only.
    base = (int(random_table(seed + 100, 1)[0]) & ~7) | 3
    power, span, run = base, 1, hashes
    result, done, factor = None, 0, 1
    while True:
        if size & span:
            # result covers [p, p + done); put the next ``span`` values behind it.
            if result is None:
                result = run
            else:
                n = len(run) - done
                result = result[:n] * U64(pow(base, span, 1 << 64)) + run[done:]
            done += span
        span *= 2
        if span > size:
            return mix(result[: len(hashes) - size + 1])
        half = span // 2
        run = run[:-half] * U64(pow(base, half, 1 << 64)) + run[half:]


def pack_planes(values: np.ndarray, width: int) -> bytes:
    """Sorted 64-bit values as byte planes of their differences.

    The upper planes of small differences are zeros, which the shuffle's own
    compression removes.
    """
    steps = np.diff(values, prepend=U64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack_planes(packed: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(width, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :width] = planes.T
    return np.cumsum(steps.view(U64).ravel(), dtype=U64)


class WordNumbers(dict):
    """Numbers of words; a new word gets the next number and waits to be learnt."""

    def __init__(self) -> None:
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

"""Array-at-a-time text primitives shared by the operators of this subpackage.

Everything works on whole Arrow string columns as one flat byte buffer, so no
Python object is made per word.  Memory is bounded by the chunk size, or by
one document where a document is longer than a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once by the array code.
CHUNK_BYTES = 1 << 19

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


_SYMBOL = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            t = np.full(size, U64(base), U64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=U64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


class Words:
    """Where the words ``[^\\x20\\x09-\\x0D]+`` of a run of rows start and end.

    ``first[i]:first[i + 1]`` are the words of row i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        space = _SPACE[data]
        word = ~space
        before = np.empty(len(data) + 1, bool)
        before[1:] = space
        before[offsets] = True  # a row's first byte has nothing before it, its last nothing after
        self.start = np.flatnonzero(word & before[:-1])
        after = np.empty(len(data) + 1, bool)
        after[:-1] = space
        after[offsets] = True
        self.end = np.flatnonzero(word & after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self, data: np.ndarray, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word's bytes, A-Z as a-z if ``lower``."""
        return span_hashes(_LOWER[data] if lower else data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_SYMBOL[data] * power[: len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * inverse[start]
    return mix(h + (end - start).astype(U64) * _M1)


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``width`` words of each row, and where each row's begin.

    A row with fewer words has its whole sequence as its only window; one
    without words has none.
    """
    count = np.diff(first)
    n = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    at = np.zeros(len(count) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    row = np.repeat(np.arange(len(count)), n)
    pos = first[:-1][row] + (np.arange(at[-1]) - at[:-1][row])
    short = count[row] < width
    padded = np.concatenate([h, np.zeros(width, U64)])
    out = np.zeros(at[-1], U64)
    for k in range(width):
        part = padded[pos + k] * U64((_BASE * (2 * k + 3)) & (2**64 - 1) | 1)
        part[short & (k >= count[row])] = U64(k + 1)
        out = mix(out + part) if k else part
    return mix(out), at

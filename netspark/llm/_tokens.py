"""Words of whole Arrow string columns as numpy arrays, without a Python object per word.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII
characters of the lower-cased text; in RE2 and Java ``[0-9a-z_\\x{80}-\\x{10FFFF}]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _INV = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes of text that are worked on at once.
CHUNK_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _word_bytes() -> np.ndarray:
    t = np.zeros(256, bool)
    t[128:] = True
    t[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"]] = True
    return t


WORD = _word_bytes()
BYTE = mix(np.arange(1, 257, dtype=U) * _BASE)


def string_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (they become empty strings)."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array and the offsets of its rows within them."""
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes, or one row."""
    o = raw(column)[1]
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(o, o[a] + most, "right")) - 1)
        yield a, b
        a = b


class Words:
    """Words of some rows: ``hash``, ``row``, ``start`` and ``end`` in bytes of the lower-cased rows; ``first`` has the index of each row's first word, and their number at the end."""

    def __init__(self, hash_: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray):
        self.hash, self.row, self.start, self.end, self.first = hash_, row, start, end, first


class Splitter:
    """Splits rows into words; keeps the powers of the hash's base between calls."""

    def __init__(self) -> None:
        self.pow = self.inv = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.pow) < n:
            n = max(n, 2 * len(self.pow))
            self.pow = np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, _BASE, U), dtype=U)])
            self.inv = np.concatenate([np.ones(1, U), np.cumprod(np.full(n - 1, _INV, U), dtype=U)])

    def words(self, column: pa.Array) -> Words:
        low = pc.utf8_lower(column)
        data, offsets = raw(low)
        return self.words_of(data, offsets)

    def words_of(self, data: np.ndarray, offsets: np.ndarray, of: np.ndarray = WORD) -> Words:
        """Runs of the bytes marked in of."""
        n, rows = len(data), len(offsets) - 1
        is_word = of[data]
        before = np.zeros(n, bool)
        before[1:] = is_word[:-1]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        after = np.zeros(n, bool)
        after[:-1] = is_word[1:]
        after[cuts - 1] = False
        start = np.flatnonzero(is_word & ~before)
        end = np.flatnonzero(is_word & ~after) + 1
        self._grow(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum(BYTE[data] * self.pow[:n], out=sums[1:])
        hash_ = mix((sums[end] - sums[start]) * self.inv[start] + (end - start).astype(U))
        first = np.searchsorted(start, offsets)
        row = np.repeat(np.arange(rows), np.diff(first))
        return Words(hash_, row, start, end, first)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, and the index of each run's first word."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(words.row[:n] == words.row[k - 1 :])
    x = np.zeros(n, U)
    for j in range(k):
        x = x * _BASE + words.hash[j : j + n]
    return mix(x[at] + U(k)), at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

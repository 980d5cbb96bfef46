"""Vectorised text kernel: words and rolling hashes of whole Arrow batches in numpy.

All functions work on the UTF-8 bytes of many texts at once, so the cost per text is a few numpy
calls divided by the texts of a slice, and memory follows the slice, not the partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every input bit reaches every output bit."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    BYTE = splitmix(np.arange(1, 257, dtype=U))
STEP = 0x9E3779B97F4A7C15 | 1

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that part tokens when punctuation is ignored: all of ASCII but letters and digits.
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """STEP**0 .. STEP**(n-1) modulo 2**64, kept between calls."""
    global _powers
    while len(_powers) < n:
        _powers = np.concatenate([_powers, _powers * U(pow(STEP, len(_powers), 1 << 64))])
    return _powers[:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its offsets (one more than rows); a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges of at most so many bytes each, or of one row."""
    rows, i = len(offsets) - 1, 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, fold: np.ndarray | None = LOWER):
    """Start byte, 64-bit hash and row of every word, and the words before each row (one more than rows)."""
    n, rows = len(data), len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    gap = space[data]
    first = ~gap
    first[1:] &= gap[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = ~gap[edges]
    start = np.flatnonzero(first)
    if not len(start):
        return start, np.zeros(0, U), start, np.zeros(rows + 1, np.int64)
    span = np.diff(np.append(start, n))
    at = np.arange(start[0], n) - np.repeat(start, span)
    with np.errstate(over="ignore"):
        value = BYTE[data[start[0] :] if fold is None else fold[data[start[0] :]]]
        value *= powers(int(span.max()))[at]
        value[gap[start[0] :]] = 0
        hashed = splitmix(np.add.reduceat(value, start - start[0]))
    before = np.searchsorted(start, offsets)
    return start, hashed, np.repeat(np.arange(rows), np.diff(before)), before


def shingles(hashed: np.ndarray, before: np.ndarray, k: int, short: bool):
    """Hashes of k words in a row and the row of each; with ``short`` a row of 1 to k-1 words gives its whole sequence."""
    counts = np.diff(before)
    rows = np.arange(len(counts))
    with np.errstate(over="ignore"):
        n = len(hashed) - k + 1
        if n > 0:
            mixed = np.zeros(n, U)
            for j in range(k):
                mixed += hashed[j : j + n] * U(pow(STEP, j + 1, 1 << 64))
            row = np.repeat(rows, counts)
            inside = row[:n] == row[k - 1 :]
            found, of = splitmix(mixed[inside]), row[:n][inside]
        else:
            found, of = np.zeros(0, U), np.zeros(0, np.int64)
        if short and (few := np.flatnonzero((counts > 0) & (counts < k))).size:
            extra = []
            for r in few:
                own = hashed[before[r] : before[r + 1]]
                extra.append(splitmix((own * powers(len(own) + 1)[1:]).sum(dtype=U) + U(len(own))))
            found, of = np.concatenate([found, np.array(extra, U)]), np.concatenate([of, few])
            order = np.argsort(of, kind="stable")
            found, of = found[order], of[order]
    return found, of

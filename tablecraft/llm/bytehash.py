"""Vectorised hashing of words, shingles and byte ranges over the buffers of an Arrow text column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
# Text handled at once; a single longer text is handled alone.
STEP_BYTES = 1 << 20
WORD_LENGTH = 5


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others (a bijection)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """n reproducible odd 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_BYTE = salts(256, 11)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = salts(WORD_LENGTH, 23)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class RangeHash:
    """Hashes of any byte ranges of one buffer from its prefix sums: equal bytes, equal hash, wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, dtype=U64)
        np.cumsum(_BYTE[data] * powers(_BASE, n), out=self.prefix[1:])
        self.back = powers(_BASE_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.back[start] + (end - start).astype(U64))


def text_steps(column: pa.Array | pa.ChunkedArray, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces (first row, row after the last, bytes, bounds) of a text column; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if rows == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + rows + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    if column.null_count:  # null slots may own bytes
        lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        data = np.concatenate([data[a:a + n] for a, n in zip(offsets[:-1], lengths)] or [data[:0]])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + step, side="right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the place of each text's first word in these lists (with one end bound)."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[bounds] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, bounds)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, A-Z lower-cased, and the place of each text's first word."""
    data = LOWER[data]
    start, end, first = words(data, bounds)
    return RangeHash(data)(start, end), first


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, length: int = WORD_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``length`` words and the place of each text's first run.

    A text of fewer words has one run, all its words; a text without words has none.
    """
    hashed, first = word_hashes(data, bounds)
    counts = np.diff(first)
    runs = np.where(counts >= length, counts - length + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(runs)])
    begin = np.repeat(first[:-1] - at[:-1], runs) + np.arange(at[-1])
    span = np.repeat(np.minimum(counts, length), runs)
    place = _PLACE if length == WORD_LENGTH else salts(length, 23)
    total = span.astype(U64)
    for j in range(length):
        inside = span > j
        total[inside] += hashed[begin[inside] + j] * place[j]
    return mix(total), at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

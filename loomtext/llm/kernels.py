"""Vectorised text kernels over Arrow buffers, and group streams over sorted partitions."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240917))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that one pass of a kernel holds, unless a single text is longer.
BLOCK_BYTES = 1 << 20


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside those of other operators."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values of a string column, and the offset of each; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have about ``limit`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, and for each text where its words begin.

    A word is a run of bytes other than ASCII white space, with A-Z lower-cased.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    solid = ~_IS_SPACE[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    with np.errstate(over="ignore"):
        powers = np.full(n, _BASE)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE_VALUE[low] * powers, out=sums[1:])
        inverse = np.full(n, _BASE_INVERSE)
        inverse[0] = 1
        np.cumprod(inverse, out=inverse)
        hashes = mix64((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(U64))
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words of one text, in order; of the whole text if it has fewer."""
    n = len(words)
    if n == 0:
        return words
    take = min(n, k)
    with np.errstate(over="ignore"):
        out = np.full(n - take + 1, U64(take))
        for j in range(take):
            out = mix64(out * _BASE + words[j : n - take + 1 + j])
    return out


def document_shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text of a string column, in order, its shingle hashes."""
    data, offsets = text_buffer(column)
    for a, b in blocks(offsets):
        base = offsets[a]
        words, at = word_hashes(data[base : offsets[b]], offsets[a : b + 1] - base)
        for i in range(b - a):
            yield shingles(words[at[i] : at[i + 1]], k)


def minwise(values: np.ndarray, multipliers: np.ndarray, addends: np.ndarray) -> np.ndarray:
    """For each hash function the upper half of the least hash of ``values``."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, U64)
    with np.errstate(over="ignore"):
        for at in range(0, len(values), 4096):
            part = values[at : at + 4096, None] * multipliers[None, :] + addends[None, :]
            np.minimum(least, part.min(axis=0), out=least)
    return (least >> U64(32)).astype(np.uint32)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Pieces of a sorted stream in which the key columns, of integers, do not change.

    A group longer than a batch comes in several pieces, one after another.
    """
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        change = np.zeros(n - 1, dtype=bool)
        for c in columns:
            if c.null_count:
                valid = c.is_valid().to_numpy(zero_copy_only=False)
                change |= valid[1:] != valid[:-1]
                c = c.fill_null(0)  # integers stay integers, so ids beyond 2 ** 53 stay apart
            values = c.to_numpy(zero_copy_only=False)
            change |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield tuple(c[a].as_py() for c in columns), batch.slice(a, b - a)

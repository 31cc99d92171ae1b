"""Vectorised views of Arrow text columns.

A text column is handled as its UTF-8 bytes plus row offsets, in slices of bounded size, so that memory per Python worker
depends on the slice size (and on the longest single text), never on the partition. Words are maximal runs of bytes other
than space and ``\\x09-\\x0D``; these bytes never occur inside a UTF-8 sequence, so byte runs equal code-point runs.
Hashes are polynomial hashes modulo 2**64, finished with a bijective mixer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32

_powers = {"base": np.ones(1, dtype=np.uint64), "inverse": np.ones(1, dtype=np.uint64)}


def _power_table(kind: str, n: int) -> np.ndarray:
    """First n powers of the base (or of its inverse) modulo 2**64; grown on demand and kept per process."""
    table = _powers[kind]
    if len(table) < n:
        size = max(n, 2 * len(table), SLICE_BYTES + 1024)
        factors = np.full(size, _BASE if kind == "base" else _INVERSE, dtype=np.uint64)
        factors[0] = 1
        table = _powers[kind] = np.multiply.accumulate(factors)
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (murmur-style constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class TextSlice:
    """Bytes of consecutive rows ``first .. first + n``; offsets are relative to ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def prefix(self) -> np.ndarray:
        """Prefix sums P with P[e] - P[s] = sum of (byte + 1) * base**i over s <= i < e."""
        if not hasattr(self, "_prefix"):
            p = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power_table("base", len(self.data)), out=p[1:])
            self._prefix = p
        return self._prefix

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        p = self.prefix()
        inverse = _power_table("inverse", len(self.data) + 1)
        return mix((p[end] - p[start]) * inverse[start])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row) of every word in order; rows count from 0 in this slice."""
        inside = ~SPACE[self.data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        start = np.flatnonzero(begins)
        return start, np.flatnonzero(ends) + 1, self.rows_of(start)

    def rows_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, position, side="right") - 1

    def sum_by_row(self, values: np.ndarray) -> np.ndarray:
        """Sum of a per-byte value over each row."""
        c = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, out=c[1:])
        return c[self.offsets[1:]] - c[self.offsets[:-1]]


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES, table: np.ndarray | None = None) -> Iterator[TextSlice]:
    """Cuts a column into slices of whole rows with at most ``limit`` bytes each (one row may exceed it)."""
    data, offsets = bytes_of(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        part = data[offsets[at] : offsets[to]]
        yield TextSlice(part if table is None else table[part], offsets[at : to + 1] - offsets[at], at)
        at = to


def row_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows with at most ``limit`` bytes (one row may exceed it), from the lengths alone: the bytes are not copied."""
    offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to
        at = to


def same_row_windows(row: np.ndarray, size: int) -> np.ndarray:
    """Indexes i of words for which words i .. i + size - 1 lie in one row."""
    if len(row) < size:
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(row[: len(row) - size + 1] == row[size - 1 :])


def release_memory() -> None:
    """Gives freed memory back to the system; idle Python workers otherwise keep it beside the JVM's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def return_freed_arrays(threshold: int = 1 << 18) -> None:
    """From now on this process maps arrays above ``threshold`` bytes (Arrow's too) one by one, so that freeing them shrinks the
    process at once; else they stay in the heap of the C library or of Arrow's own allocator."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, threshold)  # M_MMAP_THRESHOLD
    except (OSError, AttributeError):
        pass


def lean(run: Callable) -> Callable:
    """``run`` over batches, with memory released at the end of the partition."""
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    wrapped.__name__ = run.__name__
    return wrapped


def lean_group(run: Callable) -> Callable:
    """``run`` over tables of a group, with memory released after each."""
    def one(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release_memory()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            release_memory()

    one.__name__ = two.__name__ = run.__name__
    return one if run.__code__.co_argcount == 1 else two

"""Words of Arrow text columns as numpy arrays, a block of bytes at a time.

A word is a run of anything but ``\\x20`` and ``\\x09-\\x0D``; A-Z are lower-cased. Words are told apart by 64-bit hashes of
their bytes, computed for a whole block at once.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The task function ``run``, after which the worker gives freed memory back to the system: workers are used again, and idle ones
    would keep what their last task took."""
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return task


def pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most so many rows, so that what a task makes of one at a time stays small."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = BLOCK + 1
    while size <= n:
        size *= 2
    if size not in _tables:
        _tables.clear()
        _tables[size] = _powers(_BASE, size), _powers(_INVERSE, size)
    return _tables[size]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def slices(offsets: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``block`` bytes; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + block, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _block_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of lower-cased bytes; no word crosses a bound."""
    inside = ~_IS_SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    opens[inner] = inside[inner]
    closes[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    power, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(hashes + (ends - starts).astype(np.uint64) * _STEP), starts, ends


class Words:
    """The words of rows ``first..last-1``: ``hashes``, ``starts``, ``ends`` (byte places in ``data``, the lower-cased bytes
    of these rows) and ``rows`` (where each row's words begin, with the total at the end)."""

    def __init__(self, first: int, last: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.last, self.data = first, last, data
        if len(data) <= 4 * BLOCK:
            self.hashes, self.starts, self.ends = _block_words(data, bounds)
        else:
            parts, at = [], 0
            while at < len(data):
                end = min(at + BLOCK, len(data))
                while end < len(data):
                    spaces = np.flatnonzero(_IS_SPACE[data[at:end]])
                    if len(spaces):
                        end = at + int(spaces[-1]) + 1
                        break
                    end = min(end + BLOCK, len(data))
                hashes, starts, ends = _block_words(data[at:end], np.zeros(0, np.int64))
                parts.append((hashes, starts + at, ends + at))
                at = end
            self.hashes, self.starts, self.ends = (np.concatenate(x) for x in zip(*parts))
        self.rows = np.searchsorted(self.starts, bounds)

    def text(self, i: int) -> str:
        return self.data[self.starts[i]:self.ends[i]].tobytes().decode("utf-8", "replace")


def blocks_of_words(column) -> Iterator[Words]:
    data, offsets = text_bytes(column)
    for first, last in slices(offsets):
        low, high = offsets[first], offsets[last]
        yield Words(first, last, _LOWER[data[low:high]], offsets[first:last + 1] - low)


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hash of every run of ``size`` words of one row; a shorter row is one shingle, an empty one none."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(n, size)
    out = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        out = out * _STEP + hashes[j:n - width + 1 + j]
    return mix(out + np.uint64(width))


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys may be among those of a ``store.key_filter``."""
    bits = len(bitmap).bit_length() + 2
    place = keys.view(np.uint64) >> np.uint64(64 - bits)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

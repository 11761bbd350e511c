"""Texts of an Arrow column as flat numpy arrays: bytes, words, hashes of words."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in pieces of about so many bytes; a longer text is one piece.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a string column: first row, row after the last, bytes, offsets of the rows in them. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    _, offset_buffer, data_buffer = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(offset_buffer, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        own = offsets[at : end + 1]
        yield at, end, data[own[0] : own[-1]], own - own[0]
        at = end


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes of which is_word[byte] holds: starts, ends, and for each row the first of its words (n + 1 numbers)."""
    inside = is_word[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    starts[full] = inside[full]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    ends[last] = inside[last]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(begin, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = -(-n // (1 << 20)) << 20
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], the same wherever a word stands. Works through CHUNK_BYTES (or one longer word) at a time."""
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        base = starts[a]
        z = max(a + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, "right")))
        part, first, last = data[base : ends[z - 1]], starts[a:z] - base, ends[a:z] - base
        up, down = _power(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        out[a:z] = mix((sums[last] - sums[first]) * down[first])
        a = z
    return out


def byte_table(allowed) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[b for b in range(256) if allowed(b)]] = True
    return table


#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def give_back() -> None:
    """Return freed memory to the machine: a Python worker outlives its task, and its allocators keep what they had at most."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(batches):
    """The same function over batches, after which memory is given back."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches(it)
        finally:
            give_back()

    return run

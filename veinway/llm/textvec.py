"""Vectorised text primitives over Arrow string columns: no Python object per word.

A chunk of documents is one UTF-8 buffer with document offsets; words, word hashes,
shingles and pre-tokens are NumPy arrays over that buffer.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POS = _rng.integers(1, 1 << 63, 1 << 14, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words are runs of ASCII letters, ASCII digits and anything beyond ASCII.
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def give_back() -> None:
    """Return memory that allocators hold free; workers live on through many stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def pieces(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each chunk of a batch."""
    data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    for i, j in chunks(offsets, most):
        own = offsets[i : j + 1]
        yield i, j, data[own[0] : own[-1]], own - own[0]
    del data, offsets
    give_back()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the offsets of words per document (n + 1)."""
    is_word = _IS_WORD[data]
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = is_word[cuts]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    last[cuts] = is_word[cuts]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each of some disjoint, ascending, non-empty byte spans."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    total = int(length.sum())
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    within = np.arange(total, dtype=np.int64) - np.repeat(begin, length)
    raw = data[within + np.repeat(start, length)] if total != len(data) else data
    value = _BYTE[_LOWER[raw] if lower else raw]
    value *= _POS[within & 16383] + (within >> 14).astype(np.uint64)
    return mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(word: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and their offsets per document.

    A document of fewer words, but not none, has one shingle: all its words.
    """
    count = np.diff(offsets)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    out = np.concatenate(([0], np.cumsum(n)))
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    doc = np.repeat(np.arange(len(count)), n)
    at = np.arange(out[-1]) - out[doc] + offsets[doc]
    short = count[doc] < size
    total = np.zeros(int(out[-1]), np.uint64)
    edge = offsets[doc + 1]
    for j in range(size):
        inside = at + j < edge
        total += np.where(inside, word[np.minimum(at + j, len(word) - 1)], np.uint64(0)) * _POS[j]
    total += np.where(short, count[doc].astype(np.uint64) * np.uint64(0xA0761D6478BD642F), np.uint64(0))
    return mix(total), out

"""Words and word windows of Arrow string columns as numpy arrays.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; no multi-byte UTF-8 character holds such a byte, so
bytes and code points agree on word borders. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(0x5EED))
BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Bytes or words that are hashed at a time: small enough for a processor's cache.
CHUNK = 1 << 17
SLICE = 1 << 20
_tables: dict[int, np.ndarray] = {}


def give_back() -> None:
    """Hand memory that finished work left free back to the system: idle workers live on beside other stages' tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _powers(base: int, n: int) -> np.ndarray:
    had = _tables.get(base)
    if had is None or len(had) < n:
        size = max(n, CHUNK + (1 << 16))
        out = np.full(size, base, np.uint64)
        out[0] = 1
        had = np.cumprod(out)
        if size <= 1 << 23:
            _tables[base] = had
    return had[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Words:
    """Words of a run of documents: byte borders, hashes, and the first word of each document (one entry more)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray | None = None


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row from, row to, bytes, offsets) over runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_of(data: np.ndarray, offsets: np.ndarray, hashed: bool = True, lower: bool = False) -> Words:
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64))
    word = ~SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    first = np.searchsorted(starts, offsets)
    out = Words(data, starts, ends, first)
    if hashed:
        out.hashes = _word_hashes(data, starts, ends)
    return out


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        a = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, a + CHUNK, "right")))
        b = ends[to - 1]
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(BYTE[data[a:b]] * _powers(BASE, b - a), out=sums[1:])
        s, e = starts[at:to] - a, ends[at:to] - a
        out[at:to] = mix((sums[e] - sums[s]) * _powers(INVERSE, b - a)[s] + (e - s).astype(np.uint64))
        at = to
    return out


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on, for the first len - k + 1 words; windows may cross documents."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        part = hashes[at : to + k - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _powers(BASE, len(part)), out=sums[1:])
        out[at:to] = mix((sums[k:] - sums[:-k]) * _powers(INVERSE, to - at))
    return out


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Mask over words: a window of k words of one document starts here."""
    n = int(first[-1])
    ok = np.ones(max(0, n), bool)
    last = np.minimum(k - 1, np.diff(first))
    for back in range(1, k):
        at = first[1:][last >= back] - back
        ok[at] = False
    return ok

"""Vectorised word and shingle arithmetic over Arrow string buffers, used inside Arrow tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
U64 = np.uint64

#: Bytes that separate words: space, and tab to carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> U64(shift)
        x *= U64(factor)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n + 1 positions."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, CHUNK_BYTES) + 1
        base, inverse = _BASE, pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.r_[U64(1), np.full(size, b, dtype=U64)]) for b in (base, inverse)]
    return _powers


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each value begins and ends; null counts as empty."""
    array = array.cast(pa.large_string())
    if array.null_count:
        array = array.fill_null("")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: workers live for many tasks, and two of them share an executor with its JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(array: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about `size` bytes; a long text is a run of its own."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not len(array):
        return
    data, offsets = buffers(array)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    del data, offsets
    give_back()


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run of bytes that are inside a word, and the index of its first word for each row (one more entry than rows)."""
    before = np.r_[False, inside[:-1]] if len(inside) else inside
    cut = offsets[:-1][np.diff(offsets) > 0]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False] if len(inside) else inside
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of its first word for each row (one more entry than rows)."""
    return spans(~IS_SPACE[data], offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, equal for equal bytes wherever they stand."""
    power, inverse = _power_tables(len(data))
    sums = np.r_[U64(0), np.cumsum(_BYTE[data] * power[: len(data)])]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of words[i : i + n] for each i at which all n exist."""
    total = np.zeros(max(0, len(words) - n + 1), dtype=U64)
    for k in range(n):
        total = mix(total + words[k : k + len(total)] * U64(2 * k + 3))
    return total


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-word shingles of each row, by row; with fewer words, the whole sequence is one."""
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    counts = np.diff(first)
    row_of = np.repeat(np.arange(len(counts)), counts)
    full = window_hashes(words, n)
    keep = row_of[: len(full)] == row_of[n - 1 :] if len(full) else np.zeros(0, bool)
    rows, hashes = [row_of[: len(full)][keep]], [full[keep]]
    for k in range(1, n):
        short = np.flatnonzero(counts == k)
        if len(short):
            at, total = first[:-1][short], np.full(len(short), U64(k), dtype=U64)
            for j in range(k):
                total = mix(total + words[at + j] * U64(2 * j + 1001))
            rows.append(short)
            hashes.append(total)
    row, value = np.concatenate(rows), np.concatenate(hashes)
    order = np.argsort(value)
    row, value = row[order], value[order]
    order = np.argsort(row.astype(np.uint32), kind="stable")
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]

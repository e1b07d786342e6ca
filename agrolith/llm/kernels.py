"""Vectorised word hashing over Arrow string columns.

Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z in lower case. A word is
hashed in blocks of 8 bytes: each goes through a mixing function with a salt of its place, the sum and
the length through it once more, for all words of a batch at a time and without a Python loop. Equal words have equal
hashes in each process and run. Unequal ones collide with a chance near 2^-64; there is no structure
of words (as there is for a polynomial modulo 2^64) that makes them collide.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 16


def give_back() -> None:
    """Return free memory to the system: Python workers stay alive between tasks, and their
    executor's memory is shared with what runs next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of the result depends on all bits of ``x``."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the offsets of each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _pieces(raw: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about PIECE bytes that end between two words; a longer word makes a longer one."""
    lo = 0
    while lo < len(raw):
        hi = min(len(raw), lo + PIECE)
        while hi < len(raw):
            stop = SPACE[raw[hi : hi + PIECE]] | first[hi : min(len(raw), hi + PIECE)]
            if stop.any():
                hi += int(np.argmax(stop))
                break
            hi += len(stop)
        yield lo, hi
        lo = hi


def block_hashes(padded: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs (start, length), of a byte or more each; ``padded`` has 8 bytes more than the runs."""
    at_any_byte = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    blocks = (length + 7) >> 3
    ends = np.cumsum(blocks)
    number = np.arange(int(ends[-1])) - np.repeat(ends - blocks, blocks)
    left = np.minimum(8, np.repeat(length, blocks) - 8 * number).astype(np.uint64)
    bits = at_any_byte[np.repeat(start, blocks) + 8 * number] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * left))
    salted = mix(bits ^ mix((number.astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15)))
    return mix(np.add.reduceat(salted, ends - blocks) + length.astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def word_hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order, and for each text where its words begin."""
    raw, at = text_bytes(column)
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    hashes, starts = [], []
    for lo, hi in _pieces(raw, first):
        b = np.zeros(hi - lo + 8, np.uint8)
        b[: hi - lo] = LOWER[raw[lo:hi]]
        word = ~SPACE[b[: hi - lo]]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1] | first[lo + 1 : hi]
        ends[:-1] &= ~word[1:] | first[lo + 1 : hi]
        i = np.flatnonzero(begins)
        if len(i):
            hashes.append(block_hashes(b, i, np.flatnonzero(ends) + 1 - i))
            starts.append(i + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, across text ends too; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= _U(0x9FB21C651E98DF25)
        out += h[k : k + len(out)]
    return mix(out + _U(n))

"""Texts of an Arrow batch as one byte buffer, and words and shingles over it as numpy arrays.

Memory is linear in ``CHUNK`` bytes, or in the longest text where one is longer; a text is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Give freed memory back to the system: a Python worker is kept for later tasks, beside the executor's other memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; memory goes back when the last one has been taken."""
    try:
        yield from batches
    finally:
        release()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``limit`` bytes in all, or one longer text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of MULTIPLIER and of its inverse modulo 2**64, at least n of each."""
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        m = max(n, CHUNK + 1)
        inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
        for name, base in (("p", MULTIPLIER), ("q", inverse)):
            x = np.full(m, base, dtype=np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x)
    return _POWERS["p"], _POWERS["q"]


def bounds(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie one after another in ``data``: starts, ends, and the number of words of each text.

    is_word: for each byte value, whether it belongs to a word."""
    inside = is_word[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = at[:-1][at[1:] > at[:-1]]
    before[full] = False
    after[at[1:][at[1:] > at[:-1]] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    cut = np.searchsorted(starts, at)
    return starts, ends, np.diff(cut)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """c with c[e] - c[s] = the sum over bytes of a slice, each times a power of MULTIPLIER that its place sets."""
    p, _ = _powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=c[1:])
    return c


def slice_hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices, the same wherever the slice stands."""
    _, q = _powers(len(c))
    return mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words; of its whole sequence where it has fewer."""
    n, total = len(counts), len(words)
    rolled = np.zeros(max(0, total - k + 1), np.uint64)
    for j in range(k if len(rolled) else 0):
        rolled = rolled * MULTIPLIER + mix(words[j : j + len(rolled)] + np.uint64(j + 1))
    rolled = mix(rolled)
    ends = np.cumsum(counts)
    out = []
    for i in range(n):
        e = int(ends[i])
        s = e - int(counts[i])
        if e - s >= k:
            out.append(np.unique(rolled[s : e - k + 1]))
        elif e > s:
            h = np.uint64(e - s)
            with np.errstate(over="ignore"):
                for j in range(s, e):
                    h = h * MULTIPLIER + mix(words[j : j + 1] + np.uint64(j - s + 101))[0]
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[65:91] += 32
#: Bytes of words set apart by white space of ``[\\x20\\x09-\\x0D]``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False

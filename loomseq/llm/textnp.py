"""Words of many texts at once, as NumPy arrays over an Arrow column's own bytes."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_C = np.uint64(0xD1B54A32D192ED03)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit bijection that spreads every input bit over the whole word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def frugal(run: Callable) -> Callable:
    """A function over Arrow batches that gives its task's memory back at the end: a Python worker lives on between tasks, and what its allocators keep is missing elsewhere."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return whole


def slices(column, limit: int = 4_000_000):
    """(first row, bytes, offsets) of runs of rows of about ``limit`` bytes; null texts are empty. A longer text stands alone, whole."""
    import pyarrow as pa

    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each word of texts that lie in a row in ``data``: runs of bytes that aren't ASCII white space."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    solid = ~SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets[:-1]] = True  # a text's first byte never goes on with the text before
    before = np.concatenate([[False], solid[:-1]]) & ~begins[:-1]
    starts = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]]) & ~begins[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, text) of each word.

    The hash is a 64-bit polynomial of the bytes read in eights, mixed with the length; words of up to eight bytes
    never share one by chance of their bytes alone.
    """
    starts, ends, of = spans(data, offsets)
    return hash_spans(LOWER[data] if lower else data, starts, ends), starts, ends, of


def hash_spans(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    lens = ends - starts
    h = mix(lens.astype(np.uint64) + _C)
    left = np.arange(len(starts))
    at = starts.copy()
    eights = np.lib.stride_tricks.as_strided(padded, (len(text) + 1, 8), (1, 1))
    with np.errstate(over="ignore"):
        while len(left):
            own = at[left]
            value = np.ascontiguousarray(eights[own]).view("<u8").ravel()
            have = np.minimum(ends[left] - own, 8).astype(np.uint64)
            mask = np.where(have == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(have, np.uint64(7)) * np.uint64(8))) - np.uint64(1))
            h[left] = mix((h[left] ^ (value & mask)) * _B + _C)
            at[left] += 8
            left = left[at[left] < ends[left]]
    return h


def shingles(h: np.ndarray, of: np.ndarray, n_texts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of ``k`` words; a text of fewer words, but some, has its whole sequence as its only one."""
    counts = np.bincount(of, minlength=n_texts)
    with np.errstate(over="ignore"):
        if len(h) >= k:
            n = len(h) - k + 1
            whole = of[:n] == of[k - 1 :]
            x = np.full(n, np.uint64(k), np.uint64)
            for i in range(k):
                x = mix((x ^ h[i : n + i]) * _B + _C)
            x, t = x[whole], of[:n][whole]
        else:
            x, t = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            firsts = np.searchsorted(of, short)
            y = counts[short].astype(np.uint64)
            for i in range(k - 1):
                more = counts[short] > i
                y[more] = mix((y[more] ^ h[firsts[more] + i]) * _B + _C)
            x, t = np.concatenate([x, y]), np.concatenate([t, short])
            order = np.argsort(t, kind="stable")
            x, t = x[order], t[order]
    return x, t

"""Words of whole Arrow columns as 64-bit hashes, vectorised over bytes.

A word is a maximal run of bytes of one class. The classes below hold every byte of a
non-ASCII character, so runs of bytes are runs of characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_POWERS = np.ones(1, np.uint64)
_CHUNK = 1 << 17

#: Lower-cased ASCII letters, digits and every non-ASCII byte.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Everything but ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[[32, *range(9, 14)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> np.ndarray:
    """At least the first n powers of the hash's base, modulo 2**64."""
    global _POWERS
    if n > len(_POWERS):
        size = 1 << (n - 1).bit_length()
        out = np.full(size, np.uint64(_BASE))
        out[0] = 1
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(out)
    return _POWERS


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, word offsets of the texts, hashes). A text's end always ends a word."""
    low = _LOWER[data]
    inside = members[low]
    n = len(low)
    if not n:
        none = np.zeros(0, np.int64)
        return low, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = inside & (~before | edge[:n])
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = inside & (~after | edge[1:])
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    bounds = np.searchsorted(starts, offsets)
    return low, starts, ends, bounds, hash_spans(low, starts, ends)


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the disjoint, ascending, non-empty spans of bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    total = np.cumsum(size)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # a few hundred KB at a time stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(total, total[i] - size[i] + _CHUNK, side="right")))
        n, at = size[i:j], starts[i:j]
        first = np.cumsum(n) - n
        place = np.arange(first[-1] + n[-1]) - np.repeat(first, n)
        each = _BYTE[low[np.repeat(at, n) + place]]
        each *= powers(int(n.max()) + 1)[place]
        out[i:j] = np.add.reduceat(each, first) + n.astype(np.uint64) * _STEP
        i = j
    return mix(out)


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of texts with at most so many bytes each (a longer text stands alone)."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        out.append((i, j))
        i = j
    return out

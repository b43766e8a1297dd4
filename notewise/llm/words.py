"""Vectorised word hashes over Arrow string buffers (used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
# One random odd number per byte value, from a fixed generator.
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    up, down = _powers(max(1 << 21, 1 << (n - 1).bit_length()))
    return up[:n], down[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[j] - sums[i] is base**i times the polynomial hash of data[i:j]."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][:-1], out=sums[1:])
    return sums


def texts_of(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``limit`` bytes: first row, row after the last, bytes, offsets.

    A null text is an empty one. A text longer than the slice is a slice of its own.
    """
    array = batch.column(column)
    if array.null_count:
        array = array.fill_null("")
    if not pa.types.is_large_string(array.type):
        array = array.cast(pa.large_string())
    n = len(array)
    if not n:
        return
    raw_offsets, raw_data = array.buffers()[1:3]
    offsets = np.frombuffer(raw_offsets, np.int64)[array.offset:array.offset + n + 1]
    data = np.frombuffer(raw_data, np.uint8) if raw_data is not None and raw_data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def find_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and words before each text (length texts + 1)."""
    blank = _BLANK[data]
    if lower:
        data = _LOWER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~blank
    begins = inside.copy()
    begins[1:] &= blank[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= blank[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = prefix_sums(data)
    raw = (sums[end] - sums[start]) * powers(len(data) + 1)[1][start]
    return mix(raw ^ ((end - start).astype(np.uint64) << np.uint64(40))), start, end, np.searchsorted(start, offsets)


def windows(words: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of ``size`` consecutive words, one per start (len(words) - size + 1 of them)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    spread = mix(words, salt)
    for k in range(size):
        out = out * _BASE + spread[k:k + n]
    return mix(out, salt + size)

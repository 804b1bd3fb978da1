"""Arrow columns as numpy arrays, for the operators that run in Arrow batches."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets into them; null is empty."""
    a = pc.fill_null(column, "").cast(pa.large_binary())
    if a.offset:
        a = pa.concat_arrays([a])
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def runs(sizes: np.ndarray, most: int):
    """Consecutive ranges [i, j) of items whose sizes add up to `most` at most; a larger item is a range of its own."""
    i, n = 0, len(sizes)
    while i < n:
        j, total = i + 1, int(sizes[i])
        while j < n and total + int(sizes[j]) <= most:
            total += int(sizes[j])
            j += 1
        yield i, j
        i = j


def release() -> None:
    """Gives freed memory back to the system: workers live on after a task, and so would what they held."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass

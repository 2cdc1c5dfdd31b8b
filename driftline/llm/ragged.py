"""Rows of different length that lie behind one another in one flat array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each run, behind one another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Where each row starts, and the end of the last one."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def lengths(rows: pa.Array) -> np.ndarray:
    """The length of each row of a list array; null rows are empty."""
    return np.where(np.asarray(rows.is_valid()), np.diff(np.asarray(rows.offsets, np.int64)), 0)


def listed(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Rows of ids from a flat array and the offsets of the rows."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32, copy=False)))


def packed(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Rows of bytes from a flat array and the offsets of the rows, in bytes."""
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1,
                                            [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return made.cast(pa.binary())


def slices(batch: pa.RecordBatch, sizes: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``size``, given the size of each row; one row is never cut."""
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` values at least."""
    if size <= len(array):
        return array
    more = np.empty(max(size, 2 * len(array)), array.dtype)
    more[:len(array)] = array
    return more

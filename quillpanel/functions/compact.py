"""Columns of doubles as one binary column, a row's values in as few bytes as its group's need: what kernels send through an exchange when only ranks or rounded values matter.

A row begins with a byte, the width of each of its values; 0 stands for plain doubles. Nothing is lost: values that are not whole multiples of the given decimal place travel as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def binary(rows: np.ndarray) -> pa.Array:
    """A two-dimensional array's rows, as bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.py_buffer(rows.tobytes())])


def _buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's bytes begin, and all bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    begins = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return begins, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def plain(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """The rows of binary() as an array; all have one width."""
    begins, data = _buffers(column)
    return data[begins[0] : begins[-1]].view(kind).reshape(len(begins) - 1, -1) if len(begins) > 1 else np.zeros((0, 0), kind)


def squeeze(x: np.ndarray, digits: int) -> pa.Array:
    """Rows of x (rows by columns); NaN is missing."""
    n, columns = x.shape
    missing = np.isnan(x)
    with np.errstate(invalid="ignore", over="ignore"):
        k = np.rint(x * 10.0**digits)
        whole = missing | ((np.abs(k) < 2.0**52) & (k / 10.0**digits == x))
    if not n or not whole.all():
        return binary(np.concatenate([np.zeros((n, 1), np.uint8), np.ascontiguousarray(x).view(np.uint8).reshape(n, 8 * columns)], axis=1))
    k = np.where(missing, 0, k).astype(np.int64)
    k = np.where(missing, 0, ((k << 1) ^ (k >> 63)) + 1)  # signs in the last bit, 0 for what is missing
    width = max(1, (int(k.max(initial=0)).bit_length() + 7) // 8)  # below 8
    bytes_ = np.ascontiguousarray(k).view(np.uint8).reshape(n, columns, 8)[:, :, :width].reshape(n, columns * width)
    return binary(np.concatenate([np.full((n, 1), width, np.uint8), bytes_], axis=1))


def stretch(column: pa.ChunkedArray | pa.Array, columns: int, digits: int) -> np.ndarray:
    """What squeeze() was given. Rows may come from several groups, with widths of their own."""
    begins, data = _buffers(column)
    begins = begins[:-1]
    out = np.empty((len(begins), columns))
    widths = data[begins]
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        size = width or 8
        found = data[(begins[rows].astype(np.int64) + 1)[:, None] + np.arange(columns * size)].reshape(len(rows), columns, size)
        if not width:
            out[rows] = np.ascontiguousarray(found).view(np.float64)[:, :, 0]
            continue
        k = np.zeros((len(rows), columns, 8), np.uint8)
        k[:, :, :size] = found
        k = k.view(np.int64)[:, :, 0]
        there, k = k > 0, k - 1
        out[rows] = np.where(there, ((k >> 1) ^ -(k & 1)) / 10.0**digits, np.nan)
    return out

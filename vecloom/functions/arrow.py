"""Columns of Arrow batches as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def vector_block(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rows) of the valid vectors: an id, `dim` finite components, not all zero. Rows are float64 as stored, not scaled."""
    if isinstance(ids, pa.ChunkedArray):
        ids, vectors = ids.combine_chunks(), vectors.combine_chunks()
    keep = pc.and_(pc.equal(pc.fill_null(pc.list_value_length(vectors), -1), dim), ids.is_valid())
    ids, vectors = ids.filter(keep), vectors.filter(keep)
    x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    return ids.to_numpy(zero_copy_only=False).astype(np.int64)[good], x[good]


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe against overflow of the squares."""
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a contiguous array as one binary value."""
    rows = np.ascontiguousarray(rows)
    n, width = len(rows), rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int64) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(rows)])


def from_binary(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """The array whose rows fixed_binary() packed. No nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    if not len(column):
        return np.empty((0, width), dtype=dtype)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32, count=column.offset + len(column) + 1)[column.offset :]
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view(dtype).reshape(-1, width)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads integers over all 64 bits."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))

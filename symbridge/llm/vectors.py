"""Integer vectors of Arrow list columns, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest magnitude of an integer component; under it, squared distances of 64 components and their codes fit 63 bits.
LARGEST = 1 << 26


def columns(embeddings: DataFrame, *more: str) -> DataFrame:
    """vec_id, embedding as doubles, and the further columns named; others go."""
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *more)


def integers(column: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, floor(scale * x) of their components) of the vectors with exactly `size` components, none null or non-finite."""
    whole = column.fill_null([]) if column.null_count else column
    flat = whole.flatten()
    lengths = np.diff(whole.offsets.to_numpy())
    rows = np.flatnonzero(lengths == size)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    taken = values[starts[rows][:, None] + np.arange(size)]
    if flat.null_count:
        taken[flat.is_null().to_numpy(zero_copy_only=False)[starts[rows][:, None] + np.arange(size)]] = np.nan
    finite = np.isfinite(taken).all(1)
    rows, out = rows[finite], np.floor(taken[finite] * scale)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component's integer is over {LARGEST}")
    return rows, out.astype(np.int64)


def packed(values: np.ndarray) -> pa.Array:
    """A binary column that holds each row of a matrix."""
    values = np.ascontiguousarray(values)
    size = values.strides[0] if values.ndim > 1 else values.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(values), [None, pa.py_buffer(values.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    """The matrix that packed() has stored."""
    offsets, data = column.buffers()[1:]
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw.view(kind).reshape(len(column), *shape)


def floor_means(sums: np.ndarray, counts: np.ndarray, before: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each row of sums; rows without members keep what they were."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], before)


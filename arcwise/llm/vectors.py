"""Vectors as integer matrices: which rows can be used, and how they are stored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 1 << 27
"""Integer components stay below this, so that a squared distance of 64 of them fits a long."""


def usable(vector: Column) -> Column:
    """True for vectors whose components are all present and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def integers(lists: pa.Array, scale: float) -> list[np.ndarray]:
    """floor(scale * x) of every vector of an Arrow list column, as int64."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = np.floor(np.float64(scale) * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if flat.size and np.abs(flat).max() >= LARGEST:
        raise ValueError(f"a component reaches {LARGEST} after scaling; distances and products would not fit a long")
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat.astype(np.int64), ends[:-1].astype(np.int64)) if len(lists) else []


def packed(vectors: np.ndarray) -> pa.Array:
    """Rows of an integer matrix as little-endian 32-bit binaries."""
    width = vectors.shape[1] * 4
    whole = np.ascontiguousarray(vectors, "<i4").tobytes()
    return pa.array([whole[at : at + width] for at in range(0, len(whole), width)] if width else [b""] * len(vectors), pa.binary())


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    """The matrix that ``packed`` has written, as int64."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)

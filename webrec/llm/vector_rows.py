"""Vectors of an Arrow batch as numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """The vector is there and all its components are finite numbers."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite, F.lit(False))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components in double precision, and the lengths of the vectors."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row per vector; a shorter vector counts as if zeros followed."""
    values, sizes = flat(column)
    if np.all(sizes == width):
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out

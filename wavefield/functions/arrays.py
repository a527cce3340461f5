"""Between Arrow list columns and numpy matrices, for the numeric helpers inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a 2-D array; null elements become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a 2-D array as a list column."""
    values = np.ascontiguousarray(values, dtype=float)
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def own_columns(df: DataFrame) -> DataFrame:
    """df with attributes of its own, for a cogroup with a frame of the same origin."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])

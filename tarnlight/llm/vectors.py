"""What the operators on embeddings share: usable vectors and double-precision cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is not null, not zero, holds only finite components and is as long as most of them are (of
    two lengths equally frequent, the longer)."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vec_col, lambda x: x == 0)
    good = df.where(F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(True)) & ~F.coalesce(zero, F.lit(True)))
    most = good.groupBy(F.size(vec_col).alias("dims")).count().agg(F.max_by("dims", F.struct("count", "dims"))).first()[0]
    return good.where(F.size(vec_col) == (most or 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of a list column as rows of a float64 matrix; lengths must agree."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: exact, and squares neither vanish nor overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length."""
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of row i of x and row i of y."""
    x, y = scaled(x), scaled(y)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))

"""Helpers of the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """True for a vector with entries, all of them numbers."""
    known = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & known, F.lit(False))


def clean(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose ``vector``, cast to doubles, is usable."""
    return df.withColumn(vector, F.col(vector).cast("array<double>")).where(finite(vector))


def dimension(df: DataFrame, vector: str) -> tuple[int, int]:
    """(number of rows, entries of each vector); vectors of different lengths are an error."""
    r = df.agg(F.count(F.lit(1)), F.min(F.size(vector)), F.max(F.size(vector))).first()
    if r[1] != r[2]:
        raise ValueError(f"vectors have {r[1]} to {r[2]} entries")
    return r[0], r[1] or 0


def matrix(column: pa.ListArray | pa.ChunkedArray, d: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(x) as long; what no long can hold is an error."""
    x = np.floor(x)
    if x.size and np.abs(x).max() >= 2.0**62:
        raise ValueError("an entry is beyond the range of a long")
    return x.astype(np.int64)

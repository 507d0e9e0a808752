"""Sorting, set operations and reshaping."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_series(df: DataFrame, by: Sequence[str] = ("area",), t: str = "ts", within: bool = False) -> DataFrame:
    return df.sortWithinPartitions(*by, t) if within else df.orderBy(*by, t)


def union_frames(dfs: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def missing_keys(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).join(actual.select(*keys), list(keys), "left_anti")


def common_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def to_long(df: DataFrame, keys: Sequence[str], pattern: str = r"^pred_h(\d+)$", name: str = "horizon", value: str = "yhat") -> DataFrame:
    """``pred_h*`` (or any numbered) columns to rows."""
    cols = [(c, int(m.group(1))) for c in df.columns if (m := re.match(pattern, c))]
    cells = F.array(*[F.struct(F.lit(h).alias(name), F.col(c).cast("double").alias(value)) for c, h in cols])
    return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def to_wide(df: DataFrame, keys: Sequence[str], name: str, values: Sequence, value: str, prefix: str = "pred_h") -> DataFrame:
    return df.groupBy(*keys).agg(*[
        F.max(F.when(F.col(name) == v, F.col(value))).alias(f"{prefix}{v}") for v in values
    ])


def unpivot(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), [F.col(c).cast("double").alias(c) for c in cols], name, value)


def clip(c: Column, lo, hi) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi) if not isinstance(hi, Column) else hi),
                                            F.lit(lo) if not isinstance(lo, Column) else lo))

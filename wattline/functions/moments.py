"""Aggregates of two columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over the rows that have both; null where either is constant (the built-in one
    divides by zero there, which ends the job under ANSI rules) or no row is left."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y)))

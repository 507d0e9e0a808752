"""Registry of queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.plans.ctes import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PENDING: dict[str, tuple[list[str], str]] = {}  # completed once all CTEs are known


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    half = 0.5 * 10 ** -digits
    nudge = F.lit(3.3e-4 * 10 ** -digits)  # keeps sums of different order on one side of a tie
    return df.select(*[
        F.when(F.abs(F.col(f.name)) < half, F.lit(0.0)).otherwise(F.round(F.col(f.name) + nudge, digits)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def query(name: str, sql: str | None = None, rd: str = "", use: str = "", digits: int = 6):
    """Register a query; ``rd`` names the DOUBLE columns of ``sql``, ``use`` the shared CTEs."""

    def wrap(fn):
        QUERIES[name] = lambda spark, root: rounded(fn(spark, root), digits)
        QUERIES[name].__name__ = name
        if sql:
            nudge = f"{3.3e-4 * 10 ** -digits!r}::DOUBLE"
            half = f"{0.5 * 10 ** -digits:.10f}"
            body = sql
            if rd:
                reps = ", ".join(
                    f"CASE WHEN abs({c}) < {half} THEN 0.0::DOUBLE ELSE round({c}::DOUBLE + {nudge}, {digits}) END AS {c}" for c in rd.split()
                )
                body = f"SELECT * REPLACE ({reps}) FROM (\n{sql}\n) AS q_"
            PENDING[name] = (use.split(), body)
        return fn

    return wrap


def finish() -> None:
    for name, (use, body) in PENDING.items():
        ORACLES[name] = with_ctes(use, body)

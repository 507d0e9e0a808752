"""Time-ordered folds."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.ordered import positions, stable

PART_ROWS = 20_000  # rows of a partition of a training table
FITS = 4  # fits that run beside each other


def dealt(df: DataFrame, keys: Sequence[str] = ("area", "ts"), rows: int = PART_ROWS) -> DataFrame:
    """The frame, computed once and kept, in as many partitions as its rows ask for. An iterative fit runs a
    task a partition in hundreds of small jobs, so partitions left by a shuffle would make its time."""
    once = stable(df)
    return once.repartition(max(1, -(-once.count() // rows)), *keys).sortWithinPartitions(*keys).persist()


def beside(spark: SparkSession, fit: Callable[[Any], Any], over: Iterable) -> list:
    """Independent fits from a few driver threads, results in order; the cluster shares out their tasks."""
    over = list(over)
    with ThreadPool(max(1, min(FITS, len(over)))) as pool:
        return pool.map(inheritable_thread_target(spark)(fit), over)


def time_folds(df: DataFrame, k: int, gap: int = 0, t: str = "ts", by: Sequence[str] = ("area",), name: str = "fold") -> DataFrame:
    """Block number 0..k per row: block 0 is only ever trained on, fold ``j`` tests block ``j``
    and trains on the rows before it. Block length floor(n / (k + 1)); rest goes to the last.

    ``gap`` rows before a test block are kept out of its training part: ``<name>_gap`` is
    true for them.
    """
    p = positions(df, by, t, name="__rn", total="__n")
    size = F.greatest(F.floor(F.col("__n") / (k + 1)), F.lit(1))
    block = F.least(F.floor((F.col("__rn") - 1) / size), F.lit(k)).cast("int")
    out = p.withColumn(name, block)
    if gap:
        left = (F.col(name) + 1) * size - F.col("__rn")
        out = out.withColumn(f"{name}_gap", (F.col(name) < k) & (left < gap))
    return out.drop("__rn", "__n")


def fold_rows(df: DataFrame, k: int, gap: int = 0, t: str = "ts", by: Sequence[str] = ("area",)) -> DataFrame:
    """Each row once per fold it takes part in, with its role (train / test)."""
    f = time_folds(df, k, gap, t, by, "__f")
    folds = F.sequence(F.greatest(F.col("__f"), F.lit(1)), F.lit(k))
    out = f.withColumn("fold", F.explode(folds)).withColumn("role", F.when(F.col("__f") == F.col("fold"), "test").otherwise("train"))
    if gap:
        out = out.where(~((F.col("role") == "train") & F.col("__f_gap") & (F.col("fold") == F.col("__f") + 1))).drop("__f_gap")
    return out.drop("__f")

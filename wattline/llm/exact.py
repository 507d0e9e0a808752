"""Exact duplicates by a tree merge of sorted digest runs, with DataFrame functions only.

Every task's rows form a run: one entry per digest, with the smallest identifier and a count.
Runs then meet in binomial rounds: run r joins run r >> bits, and the sorted entries of up to
2 ** bits runs are merged (Spark's sort aggregate over the shuffled runs is the multiway merge).
An entry is merged only with one whose length and second hash agree as well, so a digest
collision cannot join different texts at any level. After the last round there is one run,
which stays spread over all tasks by digest.

Null and empty texts are equal. Repeated rows are copies like others: of rows with the same
winning id the one read first stays. A null id loses to every other id. An empty table gives
no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions.ordered import stable
from wattline.llm.common import keep_listed, lower_ascii, text_of, type_of

RUNS = 256  # runs of the first level
BITS = 4  # runs that meet in a round: 2 ** BITS
ENTRY = ["digest", "n_bytes", "second"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, largest: bool = True, runs: int = RUNS, bits: int = BITS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    norm = lower_ascii(text_of(text_col))
    rows = stable(
        docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
        .select("id", F.sha2("norm", 256).alias("digest"), F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("second"))
        .withColumn("row", F.monotonically_increasing_id()).withColumn("run", F.spark_partition_id() % runs)
    )
    level = merge(rows.withColumn("n", F.lit(1).cast("long")), F.col("run"), largest, type_of(rows, "id"))
    while runs > 1:
        runs = -(-runs // 2**bits)
        level = merge(level, F.shiftright("run", bits), largest, None)
    best = level.select(*[F.col(c).alias(f"g_{c}") for c in ENTRY], F.col("best"), F.col("n").alias("group_size"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"g_{c}") for c in ENTRY])
    return rows.join(best, same).select(
        "id", F.col("best.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def merge(entries: DataFrame, run: Column, largest: bool, id_type: str | None) -> DataFrame:
    """One level: entries of the runs that meet, by digest; the winning row and the sum of counts."""
    if id_type is not None:  # rows become entries
        order = F.struct("id", (-F.col("row")).alias("back")) if largest else F.struct(F.col("id").isNull().alias("last"), "id", "row")
        entries = entries.select(run.alias("run"), *ENTRY, "n", F.struct(order.alias("order"), "id", "row").alias("best"))
    pick = F.max("best") if largest else F.min("best")
    return entries.groupBy(run.alias("run"), *ENTRY).agg(pick.alias("best"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    kept = exact_groups(docs, id_col, text_col, **kw).where("kept").select("id", F.col("text_sha256").alias("key"))
    return keep_listed(docs, kept, id_col, text_col, F.sha2(lower_ascii(text_of(text_col)), 256))

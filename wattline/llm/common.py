"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLICE_BYTES = 2 << 20  # text that a Python worker holds as objects at one time


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def text_of(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def digest(c: str) -> Column:
    """Identity of a text; null and empty are told apart."""
    return F.coalesce(F.md5(F.col(c).cast("string")), F.lit("null"))


def spread(c: str, limit: int, pieces: int = 8) -> Column:
    """A text of at most ``limit`` characters: the whole, or ``pieces`` pieces from all over it, the first and last characters included."""
    text, each = F.col(c), max(limit // pieces - 1, 1)
    at = [F.floor(i * (F.length(text) - each) / (pieces - 1)).cast("int") + 1 for i in range(pieces)]
    return F.when(F.length(text) > limit, F.concat_ws(" ", *[F.substring(text, a, F.lit(each)) for a in at])).otherwise(text)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts are about ``limit`` bytes together; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def map_text(df: DataFrame, column: str, schema: str, fn: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """``mapInArrow`` over slices of bounded bytes; ``fn`` returns the columns of ``schema`` for one slice."""
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for b in batches:
            for s in slices(b, column):
                made = fn(s)
                yield pa.RecordBatch.from_arrays([
                    made[f.name].cast(f.type) if isinstance(made[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(made[f.name], type=f.type)
                    for f in arrow
                ], schema=arrow)

    return df.mapInArrow(run, target)


def type_of(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


def keep_listed(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str, key: Column) -> DataFrame:
    """Whole rows of ``docs`` whose (id, key) is in ``kept(id, key)``; of repeated rows one.

    The row travels as one struct, so no column of ``docs`` can clash with a name used here. The
    join leaves rows ordered by its keys, on which the removal of repeats needs no other shuffle.
    """
    left = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), key.alias("key"))
    right = kept.select(F.col("id").alias("r_id"), F.col("key").alias("r_key"))
    hit = left.join(right, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")), "left_semi")
    return hit.dropDuplicates(["id", "key"]).select("row.*")


def drop_listed(docs: DataFrame, dropped: DataFrame, id_col: str, key: Column) -> DataFrame:
    """Whole rows of ``docs`` whose (id, key) is not in ``dropped(id, key)``."""
    left = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), key.alias("key"))
    right = dropped.select(F.col("id").alias("r_id"), F.col("key").alias("r_key"))
    return left.join(right, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")), "left_anti").select("row.*")

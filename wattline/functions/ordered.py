"""Ordered computation that does not put one whole series into one task.

A plain ``Window.partitionBy(area).orderBy(ts)`` sends every row of an area to a
single task. The helpers here cut each series into blocks, work inside the blocks
and carry what crosses a block boundary:

* ``bounded``        lag / lead / row frames: neighbouring rows are copied over the edge
* ``running``        cumulative sum, min, max, last: block totals first, then offsets
* ``positions``      exact row numbers, the same way
* ``value_order``    cumulative counts in order of a value, blocks from ranges of values
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_DAYS = 30
BLOCK_ROWS = 1024
VALUE_ROWS = 250_000  # distinct values of a block in order of value


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(t: str | Column) -> Column:
    """Wall-clock seconds since 1970, independent of the session time zone."""
    t = col(t)
    return (
        F.unix_date(F.to_date(t)).cast("long") * 86400
        + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    )


def day_block(t: str | Column, days: int = BLOCK_DAYS) -> Column:
    return F.floor(F.unix_date(F.to_date(col(t))) / days)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder: an explicit ``setCheckpointDir`` first, then ``spark.checkpoint.dir``.

    Only a ``local`` master, whose single process sees one disk, may fall back to a temporary
    folder; on a cluster every executor would write to a disk of its own, so that is an error.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(target)
    return path


def stable(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, survives lost executors, is computed once, and has a known size, so
    that small tables are broadcast by the optimizer and large ones are not. The table is
    deleted when the application ends.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(
    df: DataFrame, by: Sequence[str], t: str, tie: Sequence[str] = (), *,
    days: int = BLOCK_DAYS, name: str = "rn", total: str | None = None,
    block: Column | None = None,
) -> DataFrame:
    """Add the 1-based row number within ``by`` (and the group size as ``total``)."""
    by = list(by)
    b = df.withColumn("__k", day_block(t, days) if block is None else block)
    tot = b.groupBy(*by, "__k").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by).orderBy("__k")
    off = tot.select(
        *by, "__k",
        F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"),
        F.sum("__n").over(Window.partitionBy(*by)).alias("__tot"),
    )
    inner = Window.partitionBy(*by, "__k").orderBy(t, *tie)
    out = b.join(off, [*by, "__k"]).withColumn(name, F.row_number().over(inner) + F.col("__off"))
    if total:
        out = out.withColumn(total, F.col("__tot"))
    return out.drop("__k", "__off", "__tot")


def bounded(
    df: DataFrame, by: Sequence[str], t: str,
    exprs: Callable[[object], Mapping[str, Column]], *,
    back: int = 0, ahead: int = 0, step: int | None = None,
    tie: Sequence[str] = (), block_rows: int | None = None, block: Column | None = None,
) -> DataFrame:
    """Evaluate window expressions that reach at most ``back`` / ``ahead`` rows.

    ``step`` (minutes) states that the series is a full regular grid; the block is then
    a time range and only one shuffle is needed. Otherwise rows are numbered first.
    """
    by = list(by)
    rows = max(block_rows or BLOCK_ROWS, back, ahead)
    if step:
        unit, src = step * 60, df.withColumn("__pos", seconds(t))
    else:
        unit, src = 1, positions(df, by, t, tie, name="__pos", block=block).withColumn("__pos", F.col("__pos").cast("long"))
    width = rows * unit
    own = F.floor(F.col("__pos") / width)
    off = F.col("__pos") - own * width
    targets = [own]
    if back:
        targets.append(F.when(off >= width - back * unit, own + 1))
    if ahead:
        targets.append(F.when(off < ahead * unit, own - 1))
    src = src.withColumn("__ownblk", own).withColumn("__blk", F.explode(F.array_compact(F.array(*targets))))
    w = Window.partitionBy(*by, "__blk").orderBy(t, *tie)
    for name, e in exprs(w).items():
        src = src.withColumn(name, e)
    return src.where("__blk = __ownblk").drop("__blk", "__ownblk", "__pos")


def _carry(kind: str, carried: Column, inside: Column) -> Column:
    if kind == "sum":
        return F.when(carried.isNull(), inside).when(inside.isNull(), carried).otherwise(carried + inside)
    if kind == "min":
        return F.least(carried, inside)
    if kind == "max":
        return F.greatest(carried, inside)
    return F.coalesce(inside, carried)


def running(
    df: DataFrame, by: Sequence[str], t: str, specs: Mapping[str, tuple[str, Column | str]], *,
    tie: Sequence[str] = (), days: int = BLOCK_DAYS, reverse: bool = False,
    strict: bool = False, block: Column | None = None,
) -> DataFrame:
    """Cumulative aggregates over everything up to the current row.

    ``specs``: output name -> (``sum`` | ``min`` | ``max`` | ``last``, expression); ``last`` is
    the latest non-null value. ``reverse`` runs from the end; ``strict`` leaves out the
    current row.
    """
    by = list(by)
    order = [F.col(c).desc() if reverse else F.col(c).asc() for c in [t, *tie]]
    rank = F.struct(*[F.col(c) for c in [t, *tie]])
    b = df.withColumn("__k", day_block(t, days) if block is None else block)
    aggs = []
    for i, (kind, e) in enumerate(specs.values()):
        e = col(e)
        if kind == "last":
            pick = F.min_by if reverse else F.max_by
            a = pick(e, F.when(e.isNotNull(), rank))
        else:
            a = {"sum": F.sum, "min": F.min, "max": F.max}[kind](e)
        aggs.append(a.alias(f"__a{i}"))
    wb = (
        Window.partitionBy(*by)
        .orderBy(F.col("__k").desc() if reverse else F.col("__k").asc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    over = {
        "sum": lambda c: F.sum(c).over(wb), "min": lambda c: F.min(c).over(wb),
        "max": lambda c: F.max(c).over(wb), "last": lambda c: F.last(c, ignorenulls=True).over(wb),
    }
    carried = b.groupBy(*by, "__k").agg(*aggs).select(
        *by, "__k", *[over[k](f"__a{i}").alias(f"__c{i}") for i, (k, _) in enumerate(specs.values())]
    )
    end = -1 if strict else 0
    wi = Window.partitionBy(*by, "__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    inside = {
        "sum": lambda c: F.sum(c).over(wi), "min": lambda c: F.min(c).over(wi),
        "max": lambda c: F.max(c).over(wi), "last": lambda c: F.last(c, ignorenulls=True).over(wi),
    }
    out = b.join(carried, [*by, "__k"])
    out = out.select(
        "*", *[_carry(k, F.col(f"__c{i}"), inside[k](col(e))).alias(f"__o{i}") for i, (k, e) in enumerate(specs.values())]
    )
    for i, name in enumerate(specs):
        out = out.withColumn(name, F.col(f"__o{i}"))
    return out.drop("__k", *[f"__{x}{i}" for x in "co" for i in range(len(specs))])


def neighbours(
    df: DataFrame, by: Sequence[str], t: str, e: Column, prev: str, nxt: str, *, days: int = BLOCK_DAYS,
) -> DataFrame:
    """Latest non-null ``e`` at or before each row, and earliest at or after it."""
    by = list(by)
    b = df.withColumn("__e", e).withColumn("__k", day_block(t, days))
    key = F.when(F.col("__e").isNotNull(), F.col(t))
    tot = b.groupBy(*by, "__k").agg(F.max_by("__e", key).alias("__l"), F.min_by("__e", key).alias("__f"))
    w = Window.partitionBy(*by).orderBy("__k")
    carried = tot.select(
        *by, "__k",
        F.last("__l", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("__cl"),
        F.first("__f", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("__cf"),
    )
    wi = Window.partitionBy(*by, "__k").orderBy(t)
    before = F.last("__e", ignorenulls=True).over(wi.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__e", ignorenulls=True).over(wi.rowsBetween(0, Window.unboundedFollowing))
    return (
        b.join(carried, [*by, "__k"])
        .withColumn("__p", before).withColumn("__n", after)
        .withColumn(prev, F.coalesce("__p", "__cl")).withColumn(nxt, F.coalesce("__n", "__cf"))
        .drop("__e", "__k", "__cl", "__cf", "__p", "__n")
    )


def uniform(seed: int, *keys: Column | str) -> Column:
    """Repeatable number in [0, 1) from key columns; the same after a task is run again."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def value_order(
    df: DataFrame, by: Sequence[str], v: str, weights: Mapping[str, Column] | None = None,
    next_value: str | None = None,
) -> DataFrame:
    """One row per distinct value with, for each weight ``w``: ``w``, ``w_before``, ``w_total``.

    Equal values are added up before the shuffle, so a value held by a third of the rows
    is one row here. Blocks are ranges of (group, value) of about VALUE_ROWS distinct values each,
    as many as the counted rows need; totals of blocks are carried from one to the next.
    """
    by = list(by)
    weights = weights or {"n": F.lit(1)}
    src = df.where(F.col(v).isNotNull())
    vc = stable(src.groupBy(*by, v).agg(*[F.sum(e).alias(n) for n, e in weights.items()]))
    blocks = -(-vc.count() // VALUE_ROWS)  # from the footers of the written table
    if blocks > 1:
        vc = stable(vc.repartitionByRange(blocks, *by, v).withColumn("__k", F.spark_partition_id()))
        inside = Window.partitionBy(*by, "__k").orderBy(v)
    else:
        inside = Window.partitionBy(*by).orderBy(v)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    before = {n: F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in weights}
    after = F.lead(v).over(inside)
    if blocks > 1:
        tot = vc.groupBy(*by, "__k").agg(*[F.sum(n).alias(f"__s_{n}") for n in weights], F.min(v).alias("__first"))
        w = Window.partitionBy(*by).orderBy("__k")  # one row per block
        off = tot.select(
            *by, "__k",
            *[F.coalesce(F.sum(f"__s_{n}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__b_{n}") for n in weights],
            *[F.sum(f"__s_{n}").over(Window.partitionBy(*by)).alias(f"{n}_total") for n in weights],
            F.lead("__first").over(w).alias("__next"),
        )
        vc = vc.join(off, [*by, "__k"])
        before = {n: e + F.col(f"__b_{n}") for n, e in before.items()}
        after = F.coalesce(after, F.col("__next"))
        total = [F.col(f"{n}_total") for n in weights]
    else:
        total = [F.sum(n).over(Window.partitionBy(*by)).alias(f"{n}_total") for n in weights]
    cols = [*by, v, *weights, *[e.alias(f"{n}_before") for n, e in before.items()], *total]
    return vc.select(*cols, *([after.alias(next_value)] if next_value else []))


def quantiles(
    df: DataFrame, by: Sequence[str], v: str, probs: Mapping[str, float], accuracy: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per group: exact, or sketched when ``accuracy`` is given."""
    by = list(by)
    if accuracy:
        return df.groupBy(*by).agg(*[F.percentile_approx(v, p, accuracy).alias(n) for n, p in probs.items()])
    o = value_order(df, by, v)
    aggs = []
    for i, p in enumerate(probs.values()):
        pos = F.lit(float(p)) * (F.col("n_total") - 1)
        hold = lambda q: F.when((F.col("n_before") <= q) & (q < F.col("n_before") + F.col("n")), F.col(v))
        aggs += [
            F.max(hold(F.floor(pos))).alias(f"__lo{i}"), F.max(hold(F.ceil(pos))).alias(f"__hi{i}"),
            F.max(pos - F.floor(pos)).alias(f"__f{i}"),
        ]
    g = o.groupBy(*by).agg(*aggs)
    return g.select(*by, *[
        (F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(n)
        for i, n in enumerate(probs)
    ])


def average_rank(df: DataFrame, by: Sequence[str], v: str, name: str = "rank") -> DataFrame:
    """(by, value) -> rank with ties averaged, and the number of ties ``n``."""
    o = value_order(df, by, v)
    return o.select(*by, v, "n", "n_total", (F.col("n_before") + (F.col("n") + 1) / 2).alias(name))


def ema(df: DataFrame, by: Sequence[str], t: str, v: str, alpha: float, name: str, rows: int | None = None) -> DataFrame:
    """Exponential smoothing s = alpha x + (1 - alpha) s, starting at the first value.

    Blocks are smoothed from zero; what a block inherits decays with the position in it, so
    only (length, last value) of each block is carried along a series.
    """
    by, rows = list(by), rows or 256
    p = positions(df, by, t, name="__rn").withColumn("__b", F.floor((F.col("__rn") - 1) / rows).cast("long"))
    keep = 1.0 - alpha
    start = lambda: F.array().cast("array<struct<t:bigint,s:double>>")
    cells = F.array_sort(F.collect_list(F.struct(F.col("__rn").cast("long").alias("t"), F.col(v).cast("double").alias("x"))))
    step = lambda acc, c: F.concat(acc, F.array(F.struct(
        c["t"].alias("t"), (alpha * c["x"] + keep * F.coalesce(F.try_element_at(acc, F.lit(-1))["s"], F.lit(0.0))).alias("s"))))
    blocks = p.groupBy(*by, "__b").agg(cells.alias("__c"))  # at most ``rows`` entries
    blocks = blocks.withColumn("__s", F.aggregate("__c", start(), step)).withColumns({
        "__n": F.size("__c"), "__last": F.element_at("__s", -1)["s"], "__x0": F.element_at("__c", 1)["x"]})
    ends = F.array_sort(F.collect_list(F.struct("__b", F.col("__n").cast("double").alias("n"), "__last", "__x0")))
    run = blocks.groupBy(*by).agg(ends.alias("__e"))  # one entry per block
    first = F.array(F.element_at("__e", 1)["__x0"])
    carry = F.aggregate("__e", first, lambda acc, e: F.concat(acc, F.array(e["__last"] + F.pow(F.lit(keep), e["n"]) * F.element_at(acc, -1))))
    run = run.withColumn("__carry", carry)
    run = run.select(*by, F.explode(F.arrays_zip(F.col("__e").getField("__b").alias("b"), F.slice("__carry", 1, F.size("__e")).alias("c"))).alias("z"))
    run = run.select(*by, F.col("z.b").alias("__b"), F.col("z.c").alias("__in"))
    j = blocks.join(run, [*by, "__b"]).select(*by, "__b", "__in", F.explode("__s").alias("z"))
    res = j.select(*by, F.col("z.t").alias("__rn"), (F.col("z.s") + F.pow(F.lit(keep), F.col("z.t") - F.col("__b") * rows) * F.col("__in")).alias(name))
    return p.withColumn("__rn", F.col("__rn").cast("long")).drop("__b").join(res, [*by, "__rn"]).drop("__rn")

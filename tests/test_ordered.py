"""Blocked forms against plain windows and loops, with blocks small enough to matter."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from wattline.functions import ordered as O


def frame(spark, n=400, areas=("a", "b"), seed=1):
    rnd = random.Random(seed)
    rows = [(a, i, None if rnd.random() < 0.2 else round(rnd.gauss(100, 20), 2)) for a in areas for i in range(n) if rnd.random() < 0.9]
    base = spark.createDataFrame(rows, "area string, i int, load double")
    return base.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("i") * 30))


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select("area", "i", *cols).collect()), key=repr)


def test_bounded_equals_plain_window(spark):
    df = frame(spark)
    w = Window.partitionBy("area").orderBy("ts")
    make = lambda w: {"l": F.lag("load", 5).over(w), "f": F.lead("load", 3).over(w), "s": F.sum("i").over(w.rowsBetween(-6, 2)), "r": F.row_number().over(w) * 0}
    want = df.withColumns(make(w))
    got = O.bounded(df, ["area"], "ts", make, back=6, ahead=3, block_rows=7)
    assert rows(got, "l", "f", "s") == rows(want, "l", "f", "s")
    grid = spark.range(300).select(F.lit("a").alias("area"), F.col("id").cast("int").alias("i"), F.col("id").cast("double").alias("load"),
                                   (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 30).cast("int"))).alias("ts"))
    got = O.bounded(grid, ["area"], "ts", make, back=6, ahead=3, block_rows=11, step=30)
    assert rows(got, "l", "f", "s") == rows(grid.withColumns(make(w)), "l", "f", "s")


def test_running_equals_plain_window(spark):
    df = frame(spark)
    w = Window.partitionBy("area").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    specs = {"s": ("sum", "i"), "lo": ("min", "load"), "hi": ("max", "load"), "last": ("last", "load")}
    got = O.running(df, ["area"], "ts", specs, days=1)
    want = df.withColumns({"s": F.sum("i").over(w), "lo": F.min("load").over(w), "hi": F.max("load").over(w), "last": F.last("load", ignorenulls=True).over(w)})
    assert rows(got, *specs) == rows(want, *specs)
    back = O.running(df, ["area"], "ts", {"nx": ("last", "load")}, days=1, reverse=True)
    wn = Window.partitionBy("area").orderBy("ts").rowsBetween(0, Window.unboundedFollowing)
    assert rows(back, "nx") == rows(df.withColumn("nx", F.first("load", ignorenulls=True).over(wn)), "nx")


def test_positions(spark):
    df = frame(spark)
    got = O.positions(df, ["area"], "ts", days=1, total="n")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("area").orderBy("ts"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("area")))
    assert rows(got, "rn", "n") == rows(want, "rn", "n")


def test_quantiles_and_ranks_with_heavy_ties(spark):
    vals = [5.0] * 300 + [float(x) for x in np.random.default_rng(0).lognormal(3, 2, 700)]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    probs = {"p05": 0.05, "p33": 0.33, "p50": 0.5, "p99": 0.99}
    got = O.quantiles(df, ["g"], "v", probs).head()
    for n, p in probs.items():
        assert abs(got[n] - np.quantile(vals, p)) < 1e-9
    ranks = {r["v"]: r["rank"] for r in O.average_rank(df, ["g"], "v").collect()}
    s = sorted(vals)
    for v in (5.0, s[0], s[-1]):
        at = [i + 1 for i, x in enumerate(s) if x == v]
        assert ranks[v] == sum(at) / len(at)


def test_ema_equals_loop(spark):
    df = frame(spark).where("load is not null")
    got = {(r["area"], r["i"]): r["e"] for r in O.ema(df, ["area"], "ts", "load", 0.3, "e", rows=16).collect()}
    for a in ("a", "b"):
        s = None
        for r in df.where(F.col("area") == a).orderBy("ts").collect():
            s = r["load"] if s is None else 0.3 * r["load"] + 0.7 * s
            assert abs(got[a, r["i"]] - s) < 1e-8


def test_value_order_over_blocks(spark, monkeypatch):
    """Many blocks of values give what one block gives, and no block holds more than its share."""
    df = frame(spark, n=900)
    make = lambda: O.value_order(df, ["area"], "load", {"n": F.lit(1), "s": F.col("i")}, "nxt")
    want = sorted(tuple(r) for r in make().fillna(-1.0).collect())
    monkeypatch.setattr(O, "VALUE_ROWS", 50)
    assert sorted(tuple(r) for r in make().fillna(-1.0).collect()) == want
    cut = df.groupBy("area", "load").count().repartitionByRange(-(-len(want) // 50), "area", "load").withColumn("k", F.spark_partition_id())
    assert cut.groupBy("k").count().agg(F.max("count")).first()[0] <= 4 * 50

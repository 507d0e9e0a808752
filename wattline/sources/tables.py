"""Engine tables bound to the relational test tables.

``series``   half-hourly load per area from ``events``
``daily``    daily order value per nation from ``orders``
Both keep real gaps; ``filled`` / ``daily_filled`` put them on a full grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.ordered import bounded, running, seconds, stable

HALF_HOUR = 30
DAY = 1440
MODELS = ["drift", "ma", "naive", "seasonal"]


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def series(spark: SparkSession, root: str) -> DataFrame:
    ev = load(spark, root, "events").where("ts is not null and event_type is not null")
    slot = F.window("ts", "30 minutes").start
    return (
        ev.groupBy(F.col("event_type").alias("area"), slot.alias("ts"))
        .agg(F.round(F.sum("value"), 2).alias("load"))
    )


def regular_grid(df: DataFrame, by: Sequence[str], t: str, minutes: int) -> DataFrame:
    """All (by, t) from the first to the last row of each group at a fixed step."""
    chunk = max(1, 43200 // minutes)
    b = df.groupBy(*by).agg(F.min(t).alias("__lo"), F.max(t).alias("__hi"))
    last = F.floor((seconds("__hi") - seconds("__lo")) / (minutes * 60)).cast("int")
    b = b.withColumn("__last", last)
    b = b.withColumn("__c", F.explode(F.sequence(F.lit(0), "__last", F.lit(chunk))))
    b = b.withColumn("__i", F.explode(F.sequence("__c", F.least(F.col("__c") + chunk - 1, "__last"))))
    return b.select(*by, (F.col("__lo") + F.make_dt_interval(mins=F.col("__i") * minutes)).alias(t))


def on_grid(df: DataFrame, by: Sequence[str], t: str, minutes: int) -> DataFrame:
    return regular_grid(df, by, t, minutes).join(df, [*by, t], "left")


def grid(spark: SparkSession, root: str) -> DataFrame:
    """Half-hourly load on the full grid, gaps as NULL."""
    return on_grid(series(spark, root), ["area"], "ts", HALF_HOUR)


def _filled(df: DataFrame) -> DataFrame:
    return running(df, ["area"], "ts", {"load": ("last", "load")})


def filled(spark: SparkSession, root: str) -> DataFrame:
    return _filled(grid(spark, root)).select("area", "ts", "load")


def daily(spark: SparkSession, root: str) -> DataFrame:
    """Daily order value (thousands) per nation, days without orders absent."""
    o = load(spark, root, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    c = load(spark, root, "customer").select("c_custkey", "c_nationkey")
    n = load(spark, root, "nation").select("n_nationkey", F.col("n_name").alias("area"))
    per_customer_day = o.groupBy("o_custkey", F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("v"))
    return (
        per_customer_day.join(c, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", "ts").agg(F.round(F.sum("v") / 1000, 3).alias("load"))
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("area", "ts", "load")
    )


def daily_grid(spark: SparkSession, root: str) -> DataFrame:
    return on_grid(daily(spark, root), ["area"], "ts", DAY)


def daily_filled(spark: SparkSession, root: str) -> DataFrame:
    return _filled(daily_grid(spark, root)).select("area", "ts", "load")


def daily_filled_once(spark: SparkSession, root: str) -> DataFrame:
    """``daily_filled`` from one reading of the orders: the grid and the fill need the daily sums several times."""
    return _filled(on_grid(stable(daily(spark, root)), ["area"], "ts", DAY)).select("area", "ts", "load")


def exogenous(spark: SparkSession, root: str) -> DataFrame:
    """Second numeric series (stands in for temperature): mean shipped quantity per day."""
    li = load(spark, root, "lineitem")
    return li.groupBy(F.col("l_shipdate").alias("ts")).agg(F.round(F.avg("l_quantity"), 4).alias("temperature"))


def forecast_rows(
    df: DataFrame, step: int, season: int, horizons: Sequence[int] = (1, 2, 3), k: int = 6,
) -> DataFrame:
    """Four baseline forecasts per row and horizon (h rows ahead), long, next to the actual."""

    def lags(w):
        out = {}
        for h in horizons:
            past = w.rowsBetween(-h - k + 1, -h)
            last = F.lag("load", h).over(w)
            out[f"naive_{h}"] = last
            out[f"seasonal_{h}"] = F.lag("load", season).over(w)
            out[f"ma_{h}"] = F.when(F.count("load").over(past) == k, F.round(F.avg("load").over(past), 4))
            out[f"drift_{h}"] = F.round(last + h * (last - F.lag("load", h + k).over(w)) / k, 4)
        return out

    wide = bounded(df, ["area"], "ts", lags, back=max(season, max(horizons) + k), step=step)
    cells = F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(h).alias("horizon"), F.col(f"{m}_{h}").alias("yhat"))
        for h in horizons for m in MODELS
    ])
    return (
        wide.select("area", "ts", F.col("load").alias("y"), F.explode(cells).alias("c"))
        .select("area", "ts", "c.model", "c.horizon", "c.yhat", "y")
    )


def forecasts(spark: SparkSession, root: str) -> DataFrame:
    """forecasts(area, ts, model, horizon, yhat) of the half-hourly series."""
    return forecast_rows(filled(spark, root), HALF_HOUR, 48).drop("y")


def actuals(spark: SparkSession, root: str, horizons: Sequence[int] = (1, 2, 3)) -> DataFrame:
    f = filled(spark, root)
    hs = F.explode(F.array(*[F.lit(h) for h in horizons]))
    return f.select("area", "ts", hs.alias("horizon"), F.col("load").alias("y"))


def scored(spark: SparkSession, root: str) -> DataFrame:
    """Forecasts with their actual, incomplete rows removed (the aligned table)."""
    return forecast_rows(filled(spark, root), HALF_HOUR, 48).where("yhat is not null and y is not null")


def daily_scored(spark: SparkSession, root: str) -> DataFrame:
    return forecast_rows(daily_filled(spark, root), DAY, 7).where("yhat is not null and y is not null")


def hierarchy_edges(spark: SparkSession, root: str) -> DataFrame:
    """TOTAL -> region -> nation, unit weights."""
    r = load(spark, root, "region")
    n = load(spark, root, "nation")
    top = r.select(F.lit("TOTAL").alias("parent"), F.col("r_name").alias("child"))
    low = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("parent"), F.col("n_name").alias("child")
    )
    return top.unionByName(low).withColumn("weight", F.lit(1.0))

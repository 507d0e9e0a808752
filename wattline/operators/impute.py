"""Filling gaps, resampling, and cleaning of outliers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.ordered import bounded, neighbours, positions, quantiles, running, seconds, stable
from wattline.sources.tables import on_grid


def ffill(df: DataFrame, c: str, by: Sequence[str] = ("area",), t: str = "ts", limit: int | None = None, step: int | None = None) -> DataFrame:
    if limit is None:
        return running(df, by, t, {c: ("last", c)})
    fill = lambda w: {c: F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0))}
    return bounded(df, by, t, fill, back=limit, step=step)


def bfill(df: DataFrame, c: str, by: Sequence[str] = ("area",), t: str = "ts", limit: int | None = None, step: int | None = None) -> DataFrame:
    if limit is None:
        return running(df, by, t, {c: ("last", c)}, reverse=True)
    fill = lambda w: {c: F.first(c, ignorenulls=True).over(w.rowsBetween(0, limit))}
    return bounded(df, by, t, fill, ahead=limit, step=step)


def interpolate(df: DataFrame, c: str, by: Sequence[str] = ("area",), t: str = "ts", method: str = "linear",
                limit: int | None = None, both_ends: bool = False) -> DataFrame:
    """``linear`` counts rows, ``time`` / ``index`` seconds, ``nearest``, ``pad`` and ``zero`` copy.

    Linear forms extend the last value to trailing gaps; with ``both_ends`` also the first
    value to leading ones. ``limit`` fills at most that many rows of each gap.
    """
    if method == "pad":
        return ffill(df, c, by, t, limit)
    if method not in ("linear", "time", "index", "nearest", "zero"):
        raise ValueError(f"unknown method {method!r}")
    by_rows = method not in ("time", "index") or limit is not None
    src = positions(df, by, t, name="__x") if by_rows else df
    x = seconds(t) if method in ("time", "index") else F.col("__x")
    row = F.col("__x") if by_rows else F.lit(None).cast("long")
    cell = F.when(F.col(c).isNotNull(), F.struct(x.cast("double").alias("x"), F.col(c).alias("v"), row.alias("r")))
    n = neighbours(src, by, t, cell, "__a", "__z")
    ax, av, zx, zv = F.col("__a.x"), F.col("__a.v"), F.col("__z.x"), F.col("__z.v")
    inside = F.col("__a").isNotNull() & F.col("__z").isNotNull()
    if method == "nearest":
        v = F.when(inside, F.when(x - ax <= zx - x, av).otherwise(zv))
    elif method == "zero":
        v = F.when(inside, av)
    else:
        v = F.when(inside, av + (zv - av) * (x - ax) / (zx - ax)).otherwise(F.coalesce(av, zv) if both_ends else av)
    if limit is not None:
        v = F.when(F.col("__x") - F.coalesce(F.col("__a.r"), F.col("__z.r")) <= limit, v)
    return n.withColumn(c, F.coalesce(F.col(c), v)).drop("__a", "__z", "__x")


def lag_fill(df: DataFrame, c: str, by: Sequence[str] = ("area",), t: str = "ts", lag_hours: int = 24,
             rows_per_hour: int = 2, step: int | None = None) -> DataFrame:
    """Value one lag before, then two lags before; the second reads the filled column."""
    n = lag_hours * rows_per_hour

    def fill(w):
        return {
            "__f": F.coalesce(F.col(c), F.lag(c, n).over(w)),
            c: F.coalesce(F.col("__f"), F.lag("__f", 2 * n).over(w)),
        }

    return bounded(df, by, t, fill, back=3 * n, step=step).drop("__f")


def triple_pass(df: DataFrame, c: str, by: Sequence[str] = ("area",), t: str = "ts") -> DataFrame:
    """Forward then backward within the day, mean of both neighbours, then forward."""
    w = Window.partitionBy(*by, "__day").orderBy(t)  # one series day
    day = df.withColumn("__day", F.to_date(t))
    day = day.withColumn(c, F.coalesce(
        F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    )).drop("__day")
    n = neighbours(day, by, t, F.col(c), "__a", "__z")
    return n.withColumn(c, F.coalesce(c, (F.col("__a") + F.col("__z")) / 2, "__a")).drop("__a", "__z")


Step = Callable[[DataFrame, str], DataFrame]


def impute_chain(df: DataFrame, c: str, steps: Sequence[Step]) -> DataFrame:
    for s in steps:
        df = s(df, c)
    return df


def resample_30min(df: DataFrame, by: Sequence[str] = ("area",), t: str = "ts", value: str = "load", fill: bool = True) -> DataFrame:
    g = on_grid(df, by, t, 30)
    return ffill(g, value, by, t) if fill else g


def resample_hourly(df: DataFrame, by: Sequence[str] = ("area",), t: str = "ts", value: str = "load", agg: str = "mean") -> DataFrame:
    """Hours without rows inside the range stay as NULL rows."""
    aggs = {
        "mean": F.avg(value), "sum": F.sum(value), "min": F.min(value), "max": F.max(value),
        "first": F.min_by(value, t), "last": F.max_by(value, t),
    }
    if agg not in aggs:
        raise ValueError(f"unknown aggregate {agg!r}")
    h = df.groupBy(*by, F.window(t, "1 hour").start.alias("__h")).agg(aggs[agg].alias(value))
    return on_grid(h.withColumnRenamed("__h", t), by, t, 60)


def daily_mean(df: DataFrame, by: Sequence[str] = ("area",), t: str = "ts", value: str = "load", name: str = "daily_mean") -> DataFrame:
    return df.groupBy(*by, F.to_date(t).alias("day")).agg(F.avg(value).alias(name))


def fill_both(df: DataFrame, c: str, by: Sequence[str] = ("area",), t: str = "ts") -> DataFrame:
    return interpolate(df, c, by, t, "linear", both_ends=True)


def median_abs_dev(df: DataFrame, c: str, by: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """(by, median, mad) per group."""
    med = stable(quantiles(df, by, c, {"median": 0.5}, accuracy))  # one row per group
    dev = df.join(med, list(by)).select(*by, F.abs(F.col(c) - F.col("median")).alias("__d"))
    return stable(med.join(quantiles(dev, by, "__d", {"mad": 0.5}, accuracy), list(by)))


def winsorize(df: DataFrame, c: str, by: Sequence[str] = ("area",), z: float = 3.5, accuracy: int | None = None) -> DataFrame:
    """Values with a modified z above ``z`` are clipped to the 5% / 95% quantiles of the rest."""
    by = list(by)
    df = stable(df)  # read by three quantile passes
    stats = median_abs_dev(df, c, by, accuracy)
    is_out = F.coalesce((F.col("mad") > 0) & (0.6745 * F.abs(F.col(c) - F.col("median")) / F.col("mad") > z), F.lit(False))
    flagged = df.join(stats, by, "left").withColumn("__out", is_out)
    q = quantiles(flagged.where(~F.col("__out")), by, c, {"__lo": 0.05, "__hi": 0.95}, accuracy)
    clipped = F.greatest(F.least(F.col(c), F.col("__hi")), F.col("__lo"))
    return flagged.join(q, by, "left").withColumn(c, F.when(F.col("__out"), clipped).otherwise(F.col(c))).select(*df.columns)


def fill_limited(df: DataFrame, c: str, by: Sequence[str] = ("area",), t: str = "ts", limit: int = 24) -> DataFrame:
    """Linear over at most ``limit`` rows of a gap, what is left by forward then backward fill."""
    lin = interpolate(df, c, by, t, "linear", limit=limit)
    n = neighbours(lin, by, t, F.col(c), "__a", "__z")
    return n.withColumn(c, F.coalesce(c, "__a", "__z")).drop("__a", "__z")


def clean_series(df: DataFrame, c: str, by: Sequence[str] = ("area",), t: str = "ts", z: float = 3.5) -> DataFrame:
    return winsorize(fill_both(df, c, by, t), c, by, z)

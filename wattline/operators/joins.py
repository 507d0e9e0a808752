"""Joins of the source tables, forecasts and baselines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.ordered import bounded


def _suffixed(df: DataFrame, keys: Sequence[str], taken: Sequence[str], suffix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c + suffix) if c in taken and c not in keys else F.col(c) for c in df.columns])


def join_load_temp(load: DataFrame, temp: DataFrame, how: str = "left", keys=("ts", "area"), suffix="_temp") -> DataFrame:
    if how not in ("left", "right", "inner", "outer"):
        raise ValueError(f"unknown join type {how!r}")
    return load.join(_suffixed(temp, keys, load.columns, suffix), list(keys), how)


def join_holidays(df: DataFrame, hol: DataFrame, t: str = "ts") -> DataFrame:
    h = hol.withColumnRenamed("date", "__date")
    return df.join(h, F.to_date(t) == F.col("__date"), "left").drop("__date")


def join_all(load: DataFrame, temps: Sequence[tuple[str, DataFrame]], heat: DataFrame | None = None,
             hol: DataFrame | None = None, keys=("ts", "area")) -> DataFrame:
    """Load with every source joined left; a temperature source's columns carry its name."""
    out = load
    for source, t in temps:
        out = join_load_temp(out, t.drop("source"), "left", keys, "_" + source.replace("+", "plus"))
    if heat is not None:
        out = join_load_temp(out, heat, "left", keys, "_heat")
    return join_holidays(out, hol) if hol is not None else out


def pivot_temperatures(temps: DataFrame, sources: Sequence[str], value: str = "temp_celsius", keys=("ts", "area")) -> DataFrame:
    """Several sources in one long table -> one column each, so one join is enough."""
    return temps.groupBy(*keys).agg(*[
        F.max(F.when(F.col("source") == s, F.col(value))).alias(f"{value}_{s.replace('+', 'plus')}") for s in sources
    ])


def merge_features(dfs: Sequence[DataFrame], on: Sequence[str] = ("area", "ts"), how: str = "outer", dup: str = "raise") -> DataFrame:
    """``dup``: duplicate feature columns raise, or the first / last frame wins."""
    if dup not in ("raise", "keep_first", "keep_last"):
        raise ValueError(f"unknown duplicate rule {dup!r}")
    owner: dict[str, int] = {}
    for i, d in enumerate(dfs):
        for c in d.columns:
            if c in on:
                continue
            if c in owner and dup == "raise":
                raise ValueError(f"duplicate feature column {c!r}")
            if c not in owner or dup == "keep_last":
                owner[c] = i
    parts = [d.select(*on, *[c for c in d.columns if owner.get(c) == i]) for i, d in enumerate(dfs)]
    return reduce(lambda a, b: a.join(b, list(on), how), parts)


def attach_daily(df: DataFrame, daily: DataFrame, value: str = "daily_mean", by=("area",), t: str = "ts") -> DataFrame:
    """Daily value on each half-hour row; a day without one takes the mean of all days."""
    by = list(by)
    d = daily.select(*by, F.col("day").alias("__day"), F.col(value).alias("__v"))
    overall = daily.groupBy(*by).agg(F.avg(value).alias("__all"))
    return (
        df.withColumn("__day", F.to_date(t)).join(d, [*by, "__day"], "left").join(overall, by, "left")
        .withColumn(value, F.coalesce("__v", "__all")).drop("__day", "__v", "__all")
    )


def align(fc: DataFrame, act: DataFrame, keys=("ts", "area", "horizon")) -> DataFrame:
    return (
        fc.where("yhat is not null").join(act.where("y is not null").select(*keys, "y"), list(keys))
    )


def horizon_target(df: DataFrame, h: int, ppd: int, by=("area",), t: str = "ts", y: str = "load", step: int | None = None) -> DataFrame:
    """Target ``h`` days ahead, ``ppd`` rows per day."""
    n = h * ppd
    return bounded(df, by, t, lambda w: {f"target_h{h}": F.lead(y, n).over(w)}, ahead=n, step=step)


def horizon_target_by_time(df: DataFrame, h: int, by=("area",), t: str = "ts", y: str = "load") -> DataFrame:
    """Time-exact form: the row whose time stamp is ``h`` days later."""
    later = df.select(*by, (F.col(t) - F.make_dt_interval(days=F.lit(h))).alias(t), F.col(y).alias(f"target_h{h}"))
    return df.join(later, [*by, t], "left")


def model_pairs(fc: DataFrame, models: Sequence[str], keys=("ts", "area", "horizon")) -> DataFrame:
    """Rows of each pair of models (i < j) side by side.

    The models of one key are gathered into columns first, so the shuffle carries each
    forecast once instead of once per partner.
    """
    wide = pivot_models(fc, models, keys)
    ms = sorted(models)
    pairs = F.array(*[
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(a).alias("yhat_a"), F.col(b).alias("yhat_b"))
        for i, a in enumerate(ms) for b in ms[i + 1:]
    ])
    out = wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    return out.where("yhat_a is not null and yhat_b is not null")


def pivot_models(fc: DataFrame, models: Sequence[str], keys=("ts", "area", "horizon"), value: str = "yhat", keep: Sequence[str] = ()) -> DataFrame:
    """One column per model; ``keep`` columns are constant within a key (the actual)."""
    return fc.groupBy(*keys).agg(
        *[F.max(F.when(F.col("model") == m, F.col(value))).alias(m) for m in models],
        *[F.max(c).alias(c) for c in keep],
    )


def join_baseline(system: DataFrame, base: DataFrame, keys=("area", "model"), metrics=("mape",)) -> DataFrame:
    b = base.select(*keys, *[F.col(m).alias(f"baseline_{m}") for m in metrics])
    return system.join(b, list(keys))


def semi_join_days(df: DataFrame, keys: DataFrame, by=("area",), t: str = "ts") -> DataFrame:
    k = keys.select(*by, F.col("day").alias("__day"))
    return df.withColumn("__day", F.to_date(t)).join(k, [*by, "__day"], "left_semi").drop("__day")


def last_rows(df: DataFrame, by: Sequence[str], n: int, t: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows of each group, by exact position."""
    from wattline.functions.ordered import positions

    p = positions(df, by, t, tie, name="__rn", total="__n")
    return p.where(F.col("__rn") > F.col("__n") - n).drop("__rn", "__n")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    """Top ``k``: one sort-limit without ``by``, ranked per group with it.

    Each input partition keeps its own best ``k`` per group first, so a hot group
    shuffles at most ``k`` rows per partition.
    """
    if not by:
        return df.orderBy(*order).limit(k)
    pid = df.withColumn("__pid", F.spark_partition_id())
    local = Window.partitionBy(*by, "__pid").orderBy(*order)
    first = pid.withColumn("__r", F.row_number().over(local)).where(F.col("__r") <= k)
    total = Window.partitionBy(*by).orderBy(*order)
    return first.withColumn("__r", F.row_number().over(total)).where(F.col("__r") <= k).drop("__r", "__pid")

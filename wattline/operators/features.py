"""Window features, context features and the feature pipeline."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.ordered import bounded, quantiles
from wattline.operators import timeparts as D
from wattline.operators.impute import bfill, ffill

BY = ("area",)
STATS = ("mean", "std", "min", "max", "median", "sum")


def lag_features(df: DataFrame, cols: Sequence[str], periods: Sequence[int] = (1, 2, 24, 168), by: Sequence[str] = BY,
                 t: str = "ts", step: int | None = None) -> DataFrame:
    make = lambda w: {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in cols for k in periods}
    return bounded(df, by, t, make, back=max(periods), step=step)


def rolling_features(df: DataFrame, cols: Sequence[str], windows: Sequence[int], stats: Sequence[str] = ("mean", "std"),
                     by: Sequence[str] = BY, t: str = "ts", step: int | None = None) -> DataFrame:
    """Value only where all ``n`` rows of the frame are present and non-null."""
    fn = {
        "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum,
        "median": lambda c: F.percentile(c, F.lit(0.5)),
    }

    def make(w):
        out = {}
        for c in cols:
            for n in windows:
                fr = w.rowsBetween(-(n - 1), 0)
                for s in stats:
                    out[f"{c}_rolling_{n}_{s}"] = F.when(F.count(c).over(fr) == n, fn[s](c).over(fr))
        return out

    return bounded(df, by, t, make, back=max(windows), step=step)


def fill_features(df: DataFrame, cols: Sequence[str], method: str = "none", by: Sequence[str] = BY, t: str = "ts") -> DataFrame:
    if method == "none":
        return df
    fill = {"forward": ffill, "backward": bfill}[method]
    for c in cols:
        df = fill(df, c, by, t)
    return df


def null_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    from wattline.operators.quality import null_counts

    return null_counts(df, cols)


def blf_baseline(df: DataFrame, c: str = "load", reference_days: int = 28, by: Sequence[str] = BY, t: str = "ts",
                 rows_per_day: int = 24, step: int | None = None) -> DataFrame:
    """Mean of earlier rows of the same hour and weekday within the reference rows; else of
    the previous 24 rows; else the row itself."""
    n = reference_days * rows_per_day
    unit = step * 60 if step else 1

    def make(w):
        same = Window.partitionBy(*by, "__blk", F.hour(t), F.weekday(t)).orderBy("__pos").rangeBetween(-n * unit, -1)
        return {"baseline": F.coalesce(F.avg(c).over(same), F.avg(c).over(w.rowsBetween(-24, -1)), F.col(c))}

    return bounded(df, by, t, make, back=max(n, 24), step=step)


def ratio_to(value: Column, base: Column) -> Column:
    return F.greatest(F.least(F.when(base == 0, 1.0).otherwise(F.try_divide(value, base)), F.lit(10.0)), F.lit(0.1))


def baseline_ratio(df: DataFrame, c: str = "load") -> DataFrame:
    return df.withColumn("baseline_ratio", ratio_to(F.col(c), F.col("baseline")))


def baseline_correction(df: DataFrame, windows: Sequence[int] = (24, 48, 168), c: str = "load", by: Sequence[str] = BY,
                        t: str = "ts", step: int | None = None) -> DataFrame:
    dev = F.col(c) - F.col("baseline")
    make = lambda w: {f"correction_{n}": F.avg(dev).over(w.rowsBetween(-(n - 1), 0)) for n in windows}
    return bounded(df, by, t, make, back=max(windows), step=step)


def hourly_profile(df: DataFrame, c: str = "load", by: Sequence[str] = BY, t: str = "ts") -> DataFrame:
    p = df.groupBy(*by, F.hour(t).alias("__h")).agg(F.avg(c).alias("hourly_profile"))
    return (
        df.withColumn("__h", F.hour(t)).join(p, [*by, "__h"]).drop("__h")
        .withColumn("profile_deviation", F.col(c) - F.col("hourly_profile"))
    )


def load_context(df: DataFrame, by: Sequence[str] = BY, t: str = "ts", c: str = "load", step: int | None = None,
                 accuracy: int | None = None) -> DataFrame:
    def make(w):
        return {
            "load_volatility": F.coalesce(F.stddev_samp(c).over(w.rowsBetween(-47, 0)), F.lit(0.0)),
            "load_trend": F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)),
        }

    b = bounded(df, by, t, make, back=48, step=step)
    mean = df.groupBy(*by).agg(F.avg(c).alias("__m"))
    q = quantiles(df, by, c, {"__q1": 0.25, "__q3": 0.75}, accuracy)
    return b.join(mean.join(q, list(by)), list(by)).withColumns({
        "load_level": F.when(F.col("__m") > 0, F.col(c) / F.col("__m")).otherwise(0.0),
        "load_regime_low": F.coalesce((F.col(c) < F.col("__q1")).cast("int"), F.lit(0)),
        "load_regime_high": F.coalesce((F.col(c) > F.col("__q3")).cast("int"), F.lit(0)),
    }).drop("__m", "__q1", "__q3")


def weather_context(df: DataFrame, c: str = "temperature", by: Sequence[str] = BY, accuracy: int | None = None) -> DataFrame:
    mean = df.groupBy(*by).agg(F.avg(c).alias("__m"))
    q = quantiles(df, by, c, {"__lo": 0.05, "__hi": 0.95}, accuracy)
    return df.join(mean.join(q, list(by)), list(by)).withColumns({
        "temp_deviation": F.coalesce(F.col(c) - F.col("__m"), F.lit(0.0)),
        "temp_extreme_high": F.coalesce((F.col(c) > F.col("__hi")).cast("int"), F.lit(0)),
        "temp_extreme_low": F.coalesce((F.col(c) < F.col("__lo")).cast("int"), F.lit(0)),
    }).withColumn(c, F.coalesce(c, "__m")).drop("__m", "__lo", "__hi")


def time_context(df: DataFrame, t: str = "ts") -> DataFrame:
    return D.cyclical_time(D.temporal_features(df, t, ["hour", "day_of_week", "month", "is_weekend", "quarter"]), t)


@dataclass(frozen=True)
class FeatureStep:
    """A feature step is a name, the columns it adds, and a DataFrame function."""

    name: str
    outputs: Sequence[str]
    fn: Callable[..., DataFrame]
    config: Mapping[str, object] = field(default_factory=dict)


def feature_pipeline(df: DataFrame, steps: Sequence[FeatureStep], preserve: bool = True) -> DataFrame:
    """Steps in order. Name collisions are found from the declared outputs before anything runs."""
    owner = {c: "input" for c in df.columns}
    for s in steps:
        for c in s.outputs:
            if c in owner:
                raise ValueError(f"step {s.name!r} adds {c!r}, already from {owner[c]!r}")
            owner[c] = s.name
    inputs = df.columns
    for s in steps:
        df = df.transform(s.fn, **s.config)
        absent = [c for c in s.outputs if c not in df.columns]
        if absent:
            raise ValueError(f"step {s.name!r} did not add {absent}")
    return df if preserve else df.select(*[c for c in df.columns if c not in inputs or c in ("area", "ts")])

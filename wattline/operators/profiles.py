"""Daily profiles and daily-mean models.

Exponential smoothing composes blocks of a series (``smoothing.py``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from wattline.functions.ordered import bounded, quantiles
from wattline.operators.impute import daily_mean
from wattline.operators.joins import attach_daily
from wattline.operators.smoothing import holt_winters
from wattline.operators.timeparts import period_features, period_of_day

Z = {50: 0.674, 80: 1.282, 90: 1.645, 95: 1.96, 99: 2.576}
PERIODS = 48


# --- least squares from grouped sums ----------------------------------------------
@F.pandas_udf(ArrayType(DoubleType()))
def _solve(flat: pd.Series, ridge: pd.Series) -> pd.Series:
    """Coefficients from the upper triangle of the sums of products of (1, x.., y)."""
    out = []
    for a, r in zip(flat, ridge, strict=True):
        p = int((math.sqrt(8 * len(a) + 1) - 1) / 2)
        m = np.zeros((p, p))
        m[np.triu_indices(p)] = a
        m = m + np.triu(m, 1).T
        reg = r * np.eye(p - 1)
        reg[0, 0] = 0.0
        out.append(np.linalg.lstsq(m[:-1, :-1] + reg, m[:-1, -1], rcond=None)[0].tolist())
    return pd.Series(out)


def least_squares(df: DataFrame, by: Sequence[str], xs: Sequence[str], y: str, ridge: float = 0.0) -> DataFrame:
    """(by, coef array with the intercept first, n, sigma) for all groups in one aggregation."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in xs], F.col(y).cast("double")]
    ok = df.dropna(subset=[*xs, y])
    prods = [F.sum(a * b).alias(f"__p{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    g = ok.groupBy(*by).agg(*prods, F.count(F.lit(1)).alias("n"))
    k = len(cols)
    flat = F.array(*[F.col(f"__p{i}_{j}") for i in range(k) for j in range(i, k)])
    g = g.withColumn("coef", _solve(flat, F.lit(float(ridge))))
    fit = sum((F.get("coef", F.lit(i)) * F.col(f"__p{i}_{k - 1}") for i in range(k - 1)), F.lit(0.0))
    sse = F.greatest(F.col(f"__p{k - 1}_{k - 1}") - fit, F.lit(0.0))
    return g.select(*by, "coef", "n", F.sqrt(sse / F.greatest(F.col("n") - (k - 1), F.lit(1))).alias("sigma"))


def linear_value(xs: Sequence[str]) -> Column:
    return sum((F.get("coef", F.lit(i + 1)) * F.col(x) for i, x in enumerate(xs)), F.get("coef", F.lit(0)))


def fit_daily_ar(daily: DataFrame, by: Sequence[str] = ("area",), horizons: Sequence[int] = (1, 2, 3), levels: Sequence[int] = (80, 95),
                 t: str = "ts", c: str = "load", step: int | None = 1440) -> DataFrame:
    """Direct seasonal autoregression per horizon on the last value and the value a week
    before the target; forecasts from the newest day with intervals."""
    by = list(by)

    def make(w):
        out = {}
        for h in horizons:
            out[f"y_{h}"] = F.lead(c, h).over(w)
            out[f"week_{h}"] = F.lag(c, max(7 - h, 0)).over(w) if h < 7 else F.col(c)
        return out

    x = bounded(daily, by, t, make, back=7, ahead=max(horizons), step=step)
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"y_{h}").alias("y"), F.col(f"week_{h}").alias("week")) for h in horizons]))
    long = x.select(*by, t, F.col(c).alias("last"), cells.alias("z")).select(*by, t, "last", "z.*")
    coef = least_squares(long, [*by, "horizon"], ["last", "week"], "y")
    newest = long.groupBy(*by, "horizon").agg(F.max_by(F.struct(t, "last", "week"), t).alias("o")).select(*by, "horizon", "o.*")
    f = newest.join(coef, [*by, "horizon"]).withColumn("yhat", F.greatest(linear_value(["last", "week"]), F.lit(0.0)))
    for lv in levels:
        half = Z[lv] * F.col("sigma") * F.sqrt(F.col("horizon"))
        f = f.withColumns({f"lo_{lv}": F.greatest(F.col("yhat") - half, F.lit(0.0)), f"hi_{lv}": F.col("yhat") + half})
    return f.drop("coef", "last", "week").withColumnRenamed(t, "origin")


# --- exponential smoothing ----------------------------------------------------------
def hw_forecast(m: DataFrame, horizons: Sequence[int] = (1, 2, 3), season: int = 7) -> DataFrame:
    x = m.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    s = F.get("season", (F.col("steps") + F.col("horizon") - 1) % season)
    line = F.col("level") + F.col("horizon") * F.col("trend")
    return x.withColumn("yhat", F.greatest(F.when(F.col("multiplicative"), line * s).otherwise(line + s), F.lit(0.0)))


def fit_daily_hw(daily: DataFrame, by: Sequence[str] = ("area",), horizons: Sequence[int] = (1, 2, 3), t: str = "ts", c: str = "load") -> DataFrame:
    return hw_forecast(holt_winters(daily, by, t, c), horizons)


def hw_intervals(f: DataFrame, level: int = 95) -> DataFrame:
    z = 1.96 if level == 95 else 1.28
    half = z * F.sqrt(F.col("sse") / F.col("n")) * F.sqrt(1 + 0.1 * F.col("horizon"))
    return f.withColumns({"lo": F.greatest(F.col("yhat") - half, F.lit(0.0)), "hi": F.col("yhat") + half})


def hw_components(m: DataFrame, by: Sequence[str] = ("area",)) -> DataFrame:
    return m.select(*by, "level", "trend", F.posexplode("season").alias("phase", "seasonal"))


# --- profiles -----------------------------------------------------------------------
def profile_ratios(df: DataFrame, by: Sequence[str] = ("area",), t: str = "ts", c: str = "load", eps: float = 1e-8) -> DataFrame:
    """(by, day, period, ratio): value over the mean of its day, clipped to 0.01..10."""
    by = list(by)
    x = df.select(*by, F.to_date(t).alias("day"), period_of_day(t).alias("period"), F.col(c).alias("__v"))
    m = x.groupBy(*by, "day").agg(F.avg("__v").alias("__m"))
    r = F.col("__v") / (F.col("__m") + eps)
    return x.join(m, [*by, "day"]).select(*by, "day", "period", F.greatest(F.least(r, F.lit(10.0)), F.lit(0.01)).alias("ratio"))


def _day_sums(p: DataFrame, by: Sequence[str]) -> DataFrame:
    return p.groupBy(*by, "day").agg(F.sum("ratio").alias("__sum"), F.count("ratio").alias("__k"))


def normalize_profiles(p: DataFrame, target: float = 48.0, method: str = "proportional", by: Sequence[str] = ("area",)) -> DataFrame:
    """Ratios of a day sum to ``target``; days without a positive sum become uniform."""
    x = p.join(_day_sums(p, by), [*by, "day"])
    ok = F.col("__sum") > 0
    new = {"proportional": F.col("ratio") * target / F.col("__sum"), "additive": F.col("ratio") + (target - F.col("__sum")) / F.col("__k")}[method]
    uniform = F.lit(target) / F.when(F.col("__k") > 0, F.col("__k")).otherwise(F.lit(PERIODS))
    return x.withColumn("original_sum", F.col("__sum")).withColumn("ratio", F.when(ok, new).otherwise(uniform)).drop("__sum", "__k")


def denormalize_profiles(p: DataFrame, sums: DataFrame, target: float = 48.0, by: Sequence[str] = ("area",)) -> DataFrame:
    j = p.join(sums.select(*by, "day", F.col("original_sum").alias("__o")), [*by, "day"])
    return j.withColumn("ratio", F.col("ratio") * F.col("__o") / target).drop("__o")


def smooth_profiles(p: DataFrame, sigma: float = 1.0, by: Sequence[str] = ("area",)) -> DataFrame:
    """Circular Gaussian over the periods of a day; the day's sum is kept."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v / sum(w)).alias("w")) for k, v in zip(range(-r, r + 1), w, strict=True)])
    x = p.select(*by, "day", "period", "ratio", F.explode(kernel).alias("z"))
    s = x.groupBy(*by, "day", F.pmod(F.col("period") + F.col("z.k"), F.lit(PERIODS)).alias("period")).agg(F.sum(F.col("ratio") * F.col("z.w")).alias("__s"))
    j = p.join(s, [*by, "day", "period"])
    tot = j.groupBy(*by, "day").agg(F.sum("ratio").alias("__a"), F.sum("__s").alias("__b"))
    return j.join(tot, [*by, "day"]).withColumn("ratio", F.when(F.col("__b") > 0, F.col("__s") * F.col("__a") / F.col("__b")).otherwise(F.col("ratio"))).drop("__s", "__a", "__b")


def validate_profiles(p: DataFrame, lo: float = 0.01, hi: float = 10.0, target: float = 48.0, tol: float = 0.01, by: Sequence[str] = ("area",)) -> DataFrame:
    bad = F.coalesce((F.col("ratio") < lo) | (F.col("ratio") > hi), F.lit(True))
    d = p.groupBy(*by, "day").agg(F.count_if(bad).alias("__bad"), (F.abs(F.sum("ratio") - target) > tol).alias("__off"))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("days"), F.sum("__bad").alias("out_of_range"), F.count_if("__off").alias("bad_sums"))


def profile_bounds(p: DataFrame, by: Sequence[str] = ("area",), accuracy: int | None = None) -> DataFrame:
    """Per period: statistics and the clip range [q25 - 2 sd, q75 + 2 sd] within the group's range."""
    keys = [*by, "period"]
    m = p.groupBy(*keys).agg(F.avg("ratio").alias("mean"), F.stddev_samp("ratio").alias("sd"))
    q = quantiles(p, keys, "ratio", {"q25": 0.25, "q75": 0.75}, accuracy)
    g = p.groupBy(*by).agg(F.min("ratio").alias("__lo"), F.max("ratio").alias("__hi"))
    return m.join(q, keys).join(g, list(by)).withColumns({
        "lower": F.greatest(F.col("q25") - 2 * F.col("sd"), "__lo"), "upper": F.least(F.col("q75") + 2 * F.col("sd"), "__hi")}).drop("__lo", "__hi")


def train_profile_reg(p: DataFrame, by: Sequence[str] = ("area",), ridge: float = 1.0) -> DataFrame:
    """One ridge regression per (group, period) on calendar regressors, from grouped sums."""
    x = period_features(p.withColumn("day_ts", F.col("day")), "day_ts")
    return least_squares(x, [*by, "period"], PROFILE_X, "ratio", ridge)


PROFILE_X = ["is_weekend", "month_sin", "month_cos", "dow_sin", "dow_cos"]


def predict_profile_reg(model: DataFrame, days: DataFrame, by: Sequence[str] = ("area",), bounds: DataFrame | None = None) -> DataFrame:
    """``days(by, day)`` -> ratios of all periods, clipped to the bounds."""
    x = period_features(days.withColumn("day_ts", F.col("day")), "day_ts").join(model, list(by))
    f = x.select(*by, F.col("day_ts").alias("day"), "period", linear_value(PROFILE_X).alias("ratio"))
    if bounds is None:
        return f
    j = f.join(bounds.select(*by, "period", "lower", "upper"), [*by, "period"])
    return j.withColumn("ratio", F.greatest(F.least("ratio", "upper"), "lower")).drop("lower", "upper")


def train_profile_hw(p: DataFrame, by: Sequence[str] = ("area",)) -> DataFrame:
    """One smoother per (group, period) over its days."""
    return holt_winters(p, [*by, "period"], "day", "ratio", 7, allow_multiplicative=True)


def combine_profiles(daily: DataFrame, profiles: DataFrame, by: Sequence[str] = ("area",)) -> DataFrame:
    """load = daily mean x ratio (0.1..5; 1 where missing) for each of the 48 periods."""
    grid = daily.select(*by, "day", "daily_mean", F.explode(F.sequence(F.lit(0), F.lit(PERIODS - 1))).alias("period"))
    j = grid.join(profiles.select(*by, "day", "period", "ratio"), [*by, "day", "period"], "left")
    r = F.coalesce(F.greatest(F.least("ratio", F.lit(5.0)), F.lit(0.1)), F.lit(1.0))
    return j.select(*by, "day", "period", "daily_mean", F.greatest(F.col("daily_mean") * r, F.lit(0.0)).alias("load"))


def energy_check(df: DataFrame, tol: float = 0.05, by: Sequence[str] = ("area",)) -> DataFrame:
    g = df.groupBy(*by, "day").agg(F.sum("load").alias("total"), (PERIODS * F.max("daily_mean")).alias("expected"))
    rel = F.when(F.col("expected") != 0, F.abs(F.col("total") - F.col("expected")) / F.abs("expected")).otherwise(0.0)
    return g.withColumn("relative_error", rel).withColumn("conserved", F.col("relative_error") <= tol)


def profile_bound_test(p: DataFrame, lo: float = 0.3, hi: float = 2.5, by: Sequence[str] = ("area",)) -> DataFrame:
    out = (F.col("ratio") < lo) | (F.col("ratio") > hi)
    return p.groupBy(*by).agg(F.avg(out.cast("double")).alias("violation_rate"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"))


def seasonal_consistency(p: DataFrame, by: Sequence[str] = ("area",)) -> DataFrame:
    g = p.groupBy(*by, F.weekday("day").alias("__w"), F.floor(F.col("period") / 2).alias("__h")).agg(F.stddev_samp("ratio").alias("__s"))
    return g.groupBy(*by).agg(F.avg("__s").alias("mean_std"), F.max("__s").alias("max_std"))


def decompose_forecast(df: DataFrame, by: Sequence[str] = ("area",), t: str = "ts", c: str = "load") -> DataFrame:
    x = attach_daily(df, daily_mean(df, by, t, c), "daily_mean", by, t)
    return x.withColumn("ratio", F.greatest(F.least(F.col(c) / (F.col("daily_mean") + 1e-8), F.lit(10.0)), F.lit(0.01)))


def fit_two_stage(df: DataFrame, daily_model: str = "ar", profile_model: str = "reg", horizons: Sequence[int] = (1, 2, 3), by: Sequence[str] = ("area",)) -> DataFrame:
    """Daily means and ratios are modelled apart and multiplied for the days after the data."""
    by = list(by)
    d = daily_mean(df, by).withColumn("ts", F.col("day").cast("timestamp_ntz"))
    p = profile_ratios(df, by)
    if daily_model == "ar":
        f = fit_daily_ar(d, by, horizons, c="daily_mean", step=None).select(*by, "origin", "horizon", F.col("yhat").alias("daily_mean"))
    else:
        f = fit_daily_hw(d, by, horizons, c="daily_mean").select(*by, "origin", "horizon", F.col("yhat").alias("daily_mean"))
    f = f.withColumn("day", F.date_add(F.to_date("origin"), F.col("horizon")))
    if profile_model == "reg":
        prof = predict_profile_reg(train_profile_reg(p, by), f.select(*by, "day").distinct(), by, profile_bounds(p, by))
    else:
        hw = hw_forecast(train_profile_hw(p, by), horizons)
        prof = hw.select(*by, "period", F.date_add("origin", F.col("horizon")).alias("day"), F.col("yhat").alias("ratio"))
    out = combine_profiles(f.select(*by, "day", "daily_mean"), normalize_profiles(prof, by=by), by)
    return out.join(f.select(*by, "day", "horizon"), [*by, "day"])


def two_stage_checks(df: DataFrame, p: DataFrame, by: Sequence[str] = ("area",), tol: float = 0.05) -> DataFrame:
    """(by, test, value, passed): energy, bounds, seasonal consistency."""
    e = energy_check(df, tol, by).groupBy(*by).agg(F.max("relative_error").alias("value")).select(*by, F.lit("energy").alias("test"), "value", (F.col("value") <= tol).alias("passed"))
    b = profile_bound_test(p, by=by).select(*by, F.lit("bounds").alias("test"), F.col("violation_rate").alias("value"), (F.col("violation_rate") <= 0.05).alias("passed"))
    s = seasonal_consistency(p, by).select(*by, F.lit("seasonal").alias("test"), F.col("mean_std").alias("value"), (F.col("mean_std") <= 0.5).alias("passed"))
    return e.unionByName(b).unionByName(s)


def simple_intervals(fc: DataFrame, level: int = 95) -> DataFrame:
    half = Z[level] * F.abs("yhat") * 0.05 * (1 + 0.1 * F.col("horizon"))
    return fc.withColumns({"lo": F.col("yhat") - half, "hi": F.col("yhat") + half})

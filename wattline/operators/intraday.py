"""Intraday correction from recent observations. Rows: area, ts, observed, predicted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.ordered import seconds
from wattline.operators.timeparts import period_of_day

# Growth of the error with the horizon, last value repeated.
HORIZON_FACTOR = [1.0, 1.5, 1.8, 2.0, 2.1, 2.2]


def recent_errors(obs: DataFrame, decay: float = 0.95, by: Sequence[str] = ("area",)) -> DataFrame:
    newest = obs.groupBy(*by).agg(F.max("ts").alias("__new"))
    hours = (seconds("__new") - seconds("ts")) / 3600.0
    ratio = F.when(F.col("predicted") == 0, 0.0).otherwise(F.greatest(F.least(F.try_divide(F.col("observed"), F.col("predicted")) - 1, F.lit(0.5)), F.lit(-0.5)))
    return obs.join(newest, list(by)).withColumns({
        "error": F.col("observed") - F.col("predicted"), "error_ratio": ratio, "period": period_of_day("ts"), "weekday": F.weekday("ts"),
        "weight": F.pow(F.lit(decay), hours), "age_hours": hours,
    }).drop("__new")


def correction_factors(err: DataFrame, hours: float = 6.0, min_obs: int = 3, mode: str = "additive", by: Sequence[str] = ("area",)) -> DataFrame:
    """All 48 periods per group: own weighted mean error, else the overall one; groups with
    fewer than ``min_obs`` observations get none."""
    by = list(by)
    e = F.col("error" if mode == "additive" else "error_ratio")
    r = err.where(F.col("age_hours") <= hours)
    mean = F.sum(e * F.col("weight")) / F.sum("weight")
    overall = r.groupBy(*by).agg(mean.alias("__all"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_obs)
    per = r.groupBy(*by, "period").agg(mean.alias("__own"), F.count(F.lit(1)).alias("n"))
    grid = overall.withColumn("period", F.explode(F.sequence(F.lit(0), F.lit(47))))
    return grid.join(per, [*by, "period"], "left").select(*by, "period", F.coalesce("__own", "__all").alias("factor"), F.coalesce("n", F.lit(0)).alias("n"))


def apply_correction(fc: DataFrame, factors: DataFrame, mode: str = "additive", cap: float = 0.2, by: Sequence[str] = ("area",)) -> DataFrame:
    j = fc.withColumn("period", period_of_day("ts")).join(factors.select(*by, "period", "factor"), [*by, "period"], "left")
    change = F.coalesce(F.col("factor") if mode == "additive" else F.col("yhat") * F.col("factor"), F.lit(0.0))
    lim = F.abs("yhat") * cap
    return j.withColumn("corrected", F.greatest(F.col("yhat") + F.greatest(F.least(change, lim), -lim), F.lit(0.0))).drop("factor")


def correction_bounds(fc: DataFrame, err: DataFrame, z: float = 1.96, by: Sequence[str] = ("area",), value: str = "yhat") -> DataFrame:
    s = err.groupBy(*by).agg(F.coalesce(F.stddev_samp("error"), F.lit(0.0)).alias("__s"))
    factor = F.get(F.array(*[F.lit(v) for v in HORIZON_FACTOR]), F.least(F.col("horizon"), F.lit(len(HORIZON_FACTOR) - 1)))
    half = z * F.col("__s") * factor
    return fc.join(s, list(by)).withColumns({"lo": F.greatest(F.col(value) - half, F.lit(0.0)), "hi": F.col(value) + half}).drop("__s")


def error_model(err: DataFrame, alpha: float = 1.0, kind: str = "ridge"):
    """Weighted linear model of the error on period and weekday."""
    x = VectorAssembler(inputCols=["period", "weekday"], outputCol="features").transform(err.where("error is not null"))
    return LinearRegression(labelCol="error", weightCol="weight", regParam=alpha, elasticNetParam=0.0 if kind == "ridge" else 1.0).fit(x)


def correction_summary(err: DataFrame, by: Sequence[str] = ("area",)) -> DataFrame:
    return err.groupBy(*by, "period").agg(
        F.count(F.lit(1)).alias("n"), F.avg("error").alias("mean_error"), F.stddev_samp("error").alias("std_error"),
        F.avg(F.abs("error")).alias("mae"), F.avg("error_ratio").alias("mean_ratio"))

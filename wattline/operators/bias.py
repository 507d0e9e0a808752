"""Bias estimation and correction of forecasts. Input rows: ts, model keys, yhat, y."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions import tails
from wattline.functions.ordered import quantiles, seconds
from wattline.operators.folds import time_folds
from wattline.operators.stattests import two_sample
from wattline.operators.timeparts import period_of_day

E = lambda: F.col("y") - F.col("yhat")


def bias_additive(df: DataFrame, by: Sequence[str] = ("model",), max_correction: float = 0.2) -> DataFrame:
    lim = F.avg(F.abs(E())) * max_correction
    return df.groupBy(*by).agg(F.greatest(F.least(F.avg(E()), lim), -lim).alias("offset"))


def bias_multiplicative(df: DataFrame, by: Sequence[str] = ("model",), max_correction: float = 0.2, accuracy: int | None = None) -> DataFrame:
    r = df.withColumn("__r", F.col("y") / (F.col("yhat") + 1e-8)).where("__r is not null")
    q = quantiles(r, by, "__r", {"__q1": 0.25, "__q3": 0.75}, accuracy)
    iqr = F.col("__q3") - F.col("__q1")
    kept = r.join(q, list(by)).where(F.col("__r").between(F.col("__q1") - 1.5 * iqr, F.col("__q3") + 1.5 * iqr))
    f = F.greatest(F.least(F.avg("__r"), F.lit(1 + max_correction)), F.lit(1 - max_correction))
    return kept.groupBy(*by).agg(f.alias("factor"))


PARTS = {"monthly": (lambda: F.month("ts"), 6, 0.10), "weekday": (lambda: F.weekday("ts"), 5, None), "half_hour": (lambda: period_of_day("ts"), 24, 0.05)}


def bias_by_time(df: DataFrame, kind: str, by: Sequence[str] = ("model",), min_samples: int = 20, alpha: float = 0.05) -> DataFrame:
    """Mean error per calendar part, kept where there are enough groups and they differ:
    months and half-hours by their spread against the mean, weekdays by a weekend t-test."""
    by = list(by)
    part, need, spread = PARTS[kind][0](), PARTS[kind][1], PARTS[kind][2]
    x = df.withColumns({"part": part.cast("int"), "__e": E()}).where("__e is not null")
    g = x.groupBy(*by, "part").agg(F.avg("__e").alias("bias"), F.count("__e").alias("n")).where(F.col("n") >= min_samples)
    if spread is None:
        t = two_sample(x, by, "__e", F.col("part") >= 5).select(*by, (F.col("p_value") < alpha).alias("__keep"))
    else:
        t = x.groupBy(*by).agg(F.abs(F.avg("__e")).alias("__m")).join(g.groupBy(*by).agg(F.stddev_pop("bias").alias("__s")), by)
        t = t.select(*by, (F.col("__s") > spread * F.col("__m")).alias("__keep"))
    ok = g.groupBy(*by).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") >= need).join(t, by).where("__keep").select(*by)
    return g.join(ok, by, "left_semi").select(*by, F.lit(kind).alias("kind"), "part", "bias", "n")


def apply_bias(df: DataFrame, offset: DataFrame | None = None, factor: DataFrame | None = None, times: Sequence[DataFrame] = (), by: Sequence[str] = ("model",)) -> DataFrame:
    """Offset, then factor, then the calendar tables added; not below zero."""
    by, v = list(by), F.col("yhat")
    x = df
    if offset is not None:
        x, v = x.join(offset, by, "left"), v + F.coalesce("offset", F.lit(0.0))
    if factor is not None:
        x, v = x.join(factor, by, "left"), v * F.coalesce("factor", F.lit(1.0))
    for i, (kind, t) in enumerate((k, t) for k, t in zip(PARTS, times)):
        tab = t.select(*by, F.col("part").alias(f"__p{i}"), F.col("bias").alias(f"__b{i}"))
        x = x.withColumn(f"__p{i}", PARTS[kind][0]().cast("int")).join(tab, [*by, f"__p{i}"], "left")
        v = v + F.coalesce(f"__b{i}", F.lit(0.0))
    return x.withColumn("yhat", F.greatest(v, F.lit(0.0))).select(*df.columns)


def bias_report(before: DataFrame, after: DataFrame, keys: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    j = before.join(after.select(*keys, F.col("yhat").alias("__a")), list(keys))
    b, a = F.col("y") - F.col("yhat"), F.col("y") - F.col("__a")
    g = j.groupBy(*by).agg(F.avg(b).alias("bias_before"), F.avg(a).alias("bias_after"), F.avg(F.abs(b)).alias("mae_before"), F.avg(F.abs(a)).alias("mae_after"))
    return g.withColumn("mae_improvement_pct", 100 * F.try_divide(F.col("mae_before") - F.col("mae_after"), F.col("mae_before")))


def bias_spline(df: DataFrame, knots: int = 5, reg: float = 1.0):
    """Ridge on a truncated cubic basis of the forecast; returns (model, assembled-column function)."""
    q = quantiles(df.withColumn("__g", F.lit(1)), ["__g"], "yhat", {f"k{i}": i / (knots + 1) for i in range(1, knots + 1)}).head()
    at = [q[f"k{i}"] for i in range(1, knots + 1)]
    lo, width = at[0], (at[-1] - at[0]) or 1.0

    def basis(d: DataFrame) -> DataFrame:
        z = (F.col("yhat") - lo) / width
        cols = {"__b0": z, "__b1": z * z, "__b2": z * z * z}
        for i, k in enumerate(at):
            u = F.greatest(z - (k - lo) / width, F.lit(0.0))
            cols[f"__k{i}"] = u * u * u
        return VectorAssembler(inputCols=list(cols), outputCol="__f").transform(d.withColumns(cols)).drop(*cols)

    x = basis(df.where("yhat is not null and y is not null").withColumn("__e", E()))
    return LinearRegression(featuresCol="__f", labelCol="__e", predictionCol="__p", regParam=reg, elasticNetParam=0.0).fit(x), basis


def bias_tree(df: DataFrame, features: Sequence[str], depth: int = 4, min_leaf: int = 20):
    cols = ["yhat", *features]

    def basis(d: DataFrame) -> DataFrame:
        cast = {f"__c{i}": F.col(c).cast("double") for i, c in enumerate(cols)}
        return VectorAssembler(inputCols=list(cast), outputCol="__f", handleInvalid="keep").transform(d.withColumns(cast)).drop(*cast)

    x = basis(df.where("yhat is not null and y is not null").withColumn("__e", E()))
    tree = DecisionTreeRegressor(featuresCol="__f", labelCol="__e", predictionCol="__p", maxDepth=depth, minInstancesPerNode=min_leaf, seed=42)
    return tree.fit(x), basis


def corrected(df: DataFrame, model, basis) -> DataFrame:
    return model.transform(basis(df)).withColumn("yhat", F.col("yhat") + F.col("__p")).select(*df.columns)


def bias_trend(df: DataFrame, by: Sequence[str] = ("model",), alpha: float = 0.05) -> DataFrame:
    """slope per day, intercept and origin of the residuals' trend; ``kept`` when significant."""
    by = list(by)
    o = df.groupBy(*by).agg(F.min("ts").alias("origin"))
    x = (seconds("ts") - seconds("origin")) / 86400.0
    g = df.join(o, by).groupBy(*by, "origin").agg(
        F.regr_slope(E(), x).alias("slope"), F.regr_intercept(E(), x).alias("intercept"), F.regr_r2(E(), x).alias("r2"), F.count(E()).alias("n"))
    g = g.withColumn("t", F.sqrt(F.col("r2") * (F.col("n") - 2) / F.greatest(1 - F.col("r2"), F.lit(1e-12))))
    g = g.withColumn("p_value", tails.p_t(F.col("t"), F.col("n") - 2))
    return g.withColumn("kept", F.col("p_value") < alpha)


def apply_trend(df: DataFrame, trend: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    j = df.join(trend.where("kept").select(*by, "origin", "slope", "intercept"), list(by), "left")
    x = (seconds("ts") - seconds("origin")) / 86400.0
    return j.withColumn("yhat", F.col("yhat") + F.coalesce(F.col("intercept") + F.col("slope") * x, F.lit(0.0))).select(*df.columns)


def temporal_share(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Share of the residual variance explained by month and weekday means."""
    by = list(by)
    x = df.select(*by, F.month("ts").alias("mo"), F.weekday("ts").alias("wd"), E().alias("__e")).where("__e is not null")
    tot = x.groupBy(*by).agg(F.var_pop("__e").alias("__v"), F.avg("__e").alias("__m"), F.count("__e").alias("__n"))
    parts = tot
    for c in ("mo", "wd"):
        g = x.groupBy(*by, c).agg(F.avg("__e").alias("a"), F.count("__e").alias("k")).join(tot, by)
        s = g.groupBy(*by).agg(F.sum(F.col("k") * (F.col("a") - F.col("__m")) * (F.col("a") - F.col("__m")) / F.col("__n")).alias(f"__{c}"))
        parts = parts.join(s, by)
    return parts.select(*by, F.when(F.col("__v") > 0, (F.col("__mo") + F.col("__wd")) / F.col("__v")).otherwise(0.0).alias("temporal_share"))


def bias_select(df: DataFrame, folds: int = 5, use_cv: bool = True) -> DataFrame:
    """One row: spline score (R2 on time folds), temporal share, and the chosen type."""
    spark = df.sparkSession
    if not use_cv:
        return spark.createDataFrame([(None, None, "combined")], "spline double, temporal double, choice string")
    f = time_folds(df, folds, by=[c for c in ("area", "model", "horizon") if c in df.columns])
    scores = []
    for k in range(1, folds + 1):
        m, basis = bias_spline(f.where(F.col("fold") < k))
        p = m.transform(basis(f.where(F.col("fold") == k).withColumn("__e", E())))
        scores.append(p.agg(1 - F.sum(F.pow(F.col("__e") - F.col("__p"), 2)) / (F.var_pop("__e") * F.count("__e"))).head()[0])
    s = sum(scores) / len(scores)
    t = temporal_share(df.withColumn("__g", F.lit(1)), ["__g"]).head()["temporal_share"]
    choice = "combined" if abs(s - t) < 0.1 else ("spline" if s > t else "temporal")
    return spark.createDataFrame([(float(s), float(t), choice)], "spline double, temporal double, choice string")


def bias_advanced(df: DataFrame, trend: DataFrame | None = None, spline=None, tree=None, times: Sequence[DataFrame] = (), cap: float = 0.3, by: Sequence[str] = ("model",)) -> DataFrame:
    """Trend, spline, tree, calendar tables; the whole change is at most ``cap`` of the value."""
    x = df.withColumn("__orig", F.col("yhat"))
    if trend is not None:
        x = apply_trend(x, trend, by)
    for m in (spline, tree):
        if m is not None:
            x = corrected(x, *m)
    if times:
        x = apply_bias(x, times=times, by=by)
    lim = F.abs("__orig") * cap
    d = F.col("yhat") - F.col("__orig")
    return x.withColumn("yhat", F.col("__orig") + F.greatest(F.least(d, lim), -lim)).select(*df.columns)

"""Accuracy metrics, error distributions, outliers, horizon analysis."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.ordered import bounded, quantiles, stable
from wattline.operators.timeparts import PERIOD_KINDS, period_label, season_number

EPS = 1e-8


def _ape(y: Column, p: Column, symmetric: bool) -> Column:
    base = (F.abs(y) + F.abs(p)) / 2 if symmetric else F.abs(y)
    return F.abs(y - p) / F.greatest(base, F.lit(EPS))


def metric_aggs(y: str = "y", p: str = "yhat", symmetric: bool = True, weight: str | None = None) -> list[Column]:
    a, b = F.col(y), F.col(p)
    e2 = (a - b) * (a - b)
    w = F.col(weight) if weight else F.lit(1.0)
    mse = F.sum(w * e2) / F.sum(w) if weight else F.avg(e2)
    mae = F.sum(w * F.abs(a - b)) / F.sum(w) if weight else F.avg(F.abs(a - b))
    ss_tot = F.var_pop(a) * F.count(a)
    r2 = F.when(ss_tot < EPS, F.when(F.sum(e2) < EPS, 1.0).otherwise(0.0)).otherwise(1 - F.sum(e2) / ss_tot)
    return [
        (100 * F.avg(_ape(a, b, symmetric))).alias("smape" if symmetric else "mape"),
        mae.alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), r2.alias("r2"), F.count(a).alias("n"),
    ]


def metrics(df: DataFrame, by: Sequence[str], symmetric: bool = True, weight: str | None = None,
            null_handling: str = "exclude", y: str = "y", p: str = "yhat") -> DataFrame:
    """Metric set per group. Rows without both values are excluded, count as zero, or fail."""
    cols = [y, p] + ([weight] if weight else [])
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    df = df.withColumn("__ok", ok)
    if null_handling == "exclude":
        df = df.withColumns({c: F.when(F.col("__ok"), F.col(c)) for c in cols})
    elif null_handling == "zero":
        df = df.withColumns({c: F.when(F.col("__ok"), F.col(c)).otherwise(0.0) for c in cols})
    elif null_handling == "error":
        fail = F.raise_error("missing value with null_handling='error'")
        df = df.withColumns({c: F.when(F.col("__ok"), F.col(c)).otherwise(fail.cast("double")) for c in cols})
    else:
        raise ValueError(f"unknown null handling {null_handling!r}")
    aggs = [*metric_aggs(y, p, symmetric, weight), F.count_if(~F.col("__ok")).alias("n_excluded")]
    return df.groupBy(*by).agg(*aggs)


def metrics_basic(df: DataFrame, by: Sequence[str]) -> DataFrame:
    e = F.col("yhat") - F.col("y")
    return df.groupBy(*by).agg(
        F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(F.when(F.col("y") != 0, F.abs(e / F.col("y"))))).alias("mape_nonzero"), F.count(F.lit(1)).alias("n"),
    )


def metrics_by_period(df: DataFrame, kind: str, min_samples: int = 10, by: Sequence[str] = (), t: str = "ts") -> DataFrame:
    m = metrics(df.withColumn("period", period_label(t, kind)), [*by, "period"]).where(F.col("n") >= min_samples)
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(kind))  # a few labels per group
    return m.withColumns({
        "best_rank": F.row_number().over(w.orderBy("smape", "period")),
        "worst_rank": F.row_number().over(w.orderBy(F.col("smape").desc(), "period")),
    })


def _partials() -> list[Column]:
    y, p = F.col("y"), F.col("yhat")
    e = y - p
    return [
        F.count(F.lit(1)).alias("n"), F.sum(_ape(y, p, True)).alias("s_ape"), F.sum(F.abs(e)).alias("s_ae"),
        F.sum(e * e).alias("s_e2"), F.sum(y).alias("s_y"), F.sum(y * y).alias("s_y2"),
    ]


def metrics_cube(df: DataFrame, kinds: Sequence[str] = tuple(PERIOD_KINDS), by: Sequence[str] = (), t: str = "ts") -> DataFrame:
    """All period kinds in one pass. Rows are first reduced to sums per (date, hour), so the
    grouping sets expand a small table, not the data."""
    hour = F.date_trunc("hour", F.col(t))
    base = df.where("y is not null and yhat is not null").groupBy(*by, hour.alias("__h")).agg(*_partials())
    labelled = base.withColumns({k: period_label("__h", k) for k in kinds})
    sums = [F.sum(c).alias(c) for c in ("n", "s_ape", "s_ae", "s_e2", "s_y", "s_y2")]
    sets = [[F.col(b) for b in by] + [F.col(k)] for k in kinds]
    g = labelled.groupingSets(sets, *[F.col(b) for b in by], *[F.col(k) for k in kinds]).agg(*sums)
    kind = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in kinds])
    ss = F.col("s_y2") - F.col("s_y") * F.col("s_y") / F.col("n")
    return g.select(
        *by, kind.alias("kind"), F.coalesce(*kinds).alias("period"), F.col("n").cast("long").alias("n"),
        (100 * F.col("s_ape") / F.col("n")).alias("smape"), (F.col("s_ae") / F.col("n")).alias("mae"),
        F.sqrt(F.col("s_e2") / F.col("n")).alias("rmse"),
        F.when(ss < EPS, F.when(F.col("s_e2") < EPS, 1.0).otherwise(0.0)).otherwise(1 - F.col("s_e2") / ss).alias("r2"),
    )


def poisson_weights(keys: np.ndarray, n: int, seed: int) -> np.ndarray:
    """rows x n Poisson(1) counts that depend only on (row key, replicate, seed)."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] + (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        u = (z ^ (z >> np.uint64(31))) / 2.0**64
    cdf = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320)])
    return np.searchsorted(cdf, u.ravel()).reshape(u.shape).astype(float)


def bootstrap_sums(df: DataFrame, by: Sequence[str], sums: dict[str, Column], key: Sequence[str], n: int, seed: int) -> DataFrame:
    """(by, replicate, weight, sums...): each task adds up its rows for every replicate and
    hands on only groups x n rows."""
    names = list(sums)
    src = df.select(*by, F.xxhash64(*key).alias("__k"), *[e.cast("double").alias(c) for c, e in sums.items()])
    types = dict(src.dtypes)
    schema = ", ".join([f"`{b}` {types[b]}" for b in by] + ["replicate int", "weight double"] + [f"`{c}` double" for c in names])

    def part(batches):
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for g, rows in pdf.groupby(list(by), sort=False, dropna=False):
                x = np.column_stack([np.ones(len(rows)), rows[names].to_numpy(float)])
                k = rows["__k"].to_numpy()
                acc = total.get(g)
                for s in range(0, len(rows), 2000):
                    add = poisson_weights(k[s:s + 2000], n, seed).T @ x[s:s + 2000]
                    acc = add if acc is None else acc + add
                total[g] = acc
        for g, acc in total.items():
            out = pd.DataFrame(acc, columns=["weight", *names])
            for b, v in zip(by, g, strict=True):
                out[b] = v
            out["replicate"] = np.arange(n, dtype=np.int32)
            yield out[[*by, "replicate", "weight", *names]]

    parts = src.mapInPandas(part, schema)
    return parts.groupBy(*by, "replicate").agg(*[F.sum(c).alias(c) for c in ("weight", *names)])


def bootstrap_ci(df: DataFrame, by: Sequence[str], key: Sequence[str], n: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    y, p = F.col("y"), F.col("yhat")
    b = bootstrap_sums(df, by, {"ape": _ape(y, p, True), "ae": F.abs(y - p), "e2": (y - p) * (y - p)}, key, n, seed)
    w = F.col("weight")
    r = b.where("weight > 0").select(*by, (100 * F.col("ape") / w).alias("smape"), (F.col("ae") / w).alias("mae"), F.sqrt(F.col("e2") / w).alias("rmse"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    return r.groupBy(*by).agg(*[  # at most n replicates per group
        F.percentile(m, F.lit(q)).alias(f"{m}_{s}") for m in ("smape", "mae", "rmse") for s, q in (("lo", lo), ("hi", hi))
    ])


def error_distribution(df: DataFrame, by: Sequence[str], e: str = "e", accuracy: int | None = None) -> DataFrame:
    q = quantiles(df, by, e, {f"p{p}": p / 100 for p in (5, 10, 25, 50, 75, 90, 95)}, accuracy)
    m = df.groupBy(*by).agg(
        F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"), F.skewness(e).alias("skewness"),
        (F.kurtosis(e) + 3).alias("kurtosis"),
    )
    return m.join(q, list(by)).withColumn("iqr", F.col("p75") - F.col("p25"))


def outliers_iqr(df: DataFrame, by: Sequence[str], v: str, k: float = 1.5, accuracy: int | None = None) -> DataFrame:
    q = quantiles(df, by, v, {"__q1": 0.25, "__q3": 0.75}, accuracy)
    iqr = F.col("__q3") - F.col("__q1")
    j = df.join(q, list(by)).withColumns({"lower": F.col("__q1") - k * iqr, "upper": F.col("__q3") + k * iqr})
    x = F.col(v)
    score = F.when(iqr > 0, F.when(x < F.col("lower"), (F.col("lower") - x) / iqr).otherwise((x - F.col("upper")) / iqr)).otherwise(0.0)
    return j.where((x < F.col("lower")) | (x > F.col("upper"))).withColumn("score", score).drop("__q1", "__q3")


def outliers_z(df: DataFrame, by: Sequence[str], v: str, k: float = 3.0) -> DataFrame:
    s = df.groupBy(*by).agg(F.avg(v).alias("__m"), F.stddev_samp(v).alias("__s")).where("__s >= 1e-10")
    return df.join(s, list(by)).withColumn("score", F.abs(F.col(v) - F.col("__m")) / F.col("__s")).where(F.col("score") > k).drop("__m", "__s")


def outliers_mad(df: DataFrame, by: Sequence[str], v: str, k: float = 3.5, accuracy: int | None = None) -> DataFrame:
    from wattline.operators.impute import median_abs_dev

    df = stable(df)  # read by two quantile passes
    s = median_abs_dev(df, v, by, accuracy).where("mad >= 1e-10")
    return (
        df.join(s, list(by)).withColumn("score", F.abs(0.6745 * (F.col(v) - F.col("median")) / F.col("mad")))
        .where(F.col("score") > k).drop("median", "mad")
    )


def compare_outliers(df: DataFrame, by: Sequence[str], v: str, accuracy: int | None = None) -> DataFrame:
    """Outlier count and share per method."""
    total = df.groupBy(*by).agg(F.count(v).alias("n"))
    parts = {
        "iqr": outliers_iqr(df, by, v, accuracy=accuracy), "zscore": outliers_z(df, by, v),
        "modified_zscore": outliers_mad(df, by, v, accuracy=accuracy),
    }
    out = None
    for name, d in parts.items():
        c = d.groupBy(*by).agg(F.count(F.lit(1)).alias("outliers"))
        c = total.join(c, list(by), "left").select(*by, F.lit(name).alias("method"), F.coalesce("outliers", F.lit(0)).alias("outliers"), "n")
        out = c if out is None else out.unionByName(c)
    return out.withColumn("share", F.col("outliers") / F.col("n"))


def metrics_by_horizon(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    m = metrics(df, [*by, "horizon"])
    return m.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.round("smape", 6), "horizon")))


def degradation(m: DataFrame, by: Sequence[str] = ("model",), metric: str = "smape", model: str = "linear") -> DataFrame:
    """Error growth over the horizon; the curved forms are fitted on logarithms."""
    h, e = F.col("horizon").cast("double"), F.col(metric)
    forms = {"linear": (h, e), "exponential": (h, F.ln(e)), "power_law": (F.ln(F.greatest(h, F.lit(0.1))), F.ln(e))}
    if model not in forms:
        raise ValueError(f"unknown model {model!r}")
    x, y = forms[model]
    f = m.groupBy(*by).agg(F.regr_slope(y, x).alias("rate"), F.regr_intercept(y, x).alias("__a"))
    fit = F.col("__a") + F.col("rate") * x
    fit = fit if model == "linear" else F.exp(fit)
    j = m.join(f, list(by)).groupBy(*by, "rate", "__a").agg(
        F.sum((e - fit) * (e - fit)).alias("__r"), (F.var_pop(e) * F.count(e)).alias("__t"))
    a = F.col("__a") if model == "linear" else F.exp("__a")
    r2 = F.when(F.col("__t") > 1e-10, 1 - F.col("__r") / F.col("__t")).otherwise(1.0)
    pattern = F.when(F.col("rate") > 0.01, "degrading").when(F.col("rate") < -0.01, "improving").otherwise("stable")
    return j.select(*by, F.lit(model).alias("growth"), a.alias("intercept"), "rate", r2.alias("r_squared"), pattern.alias("pattern"))


def skill(df: DataFrame, by: Sequence[str], t: str = "ts", baseline: str = "persistence", step: int | None = None) -> DataFrame:
    """1 - MSE / MSE of the baseline; random_walk equals persistence."""
    by = list(by)
    if baseline == "climatology":
        x = df.join(df.groupBy(*by).agg(F.avg("y").alias("__b")), by)
    elif baseline in ("persistence", "random_walk"):
        x = bounded(df, by, t, lambda w: {"__b": F.coalesce(F.lag("y").over(w), F.col("y"))}, back=1, step=step)
    else:
        raise ValueError(f"unknown baseline {baseline!r}")
    sq = lambda c: (F.col(c) - F.col("y")) * (F.col(c) - F.col("y"))
    g = x.groupBy(*by).agg(F.avg(sq("yhat")).alias("mse"), F.avg(sq("__b")).alias("mse_baseline"))
    s = F.when(F.col("mse_baseline") > 0, 1 - F.col("mse") / F.col("mse_baseline")).otherwise(F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
    return g.select(*by, F.lit(baseline).alias("baseline"), s.alias("skill"))


def compare_two_horizons(m: DataFrame, a: int, b: int, by: Sequence[str] = ("model",), metric: str = "smape") -> DataFrame:
    pick = lambda h: F.max(F.when(F.col("horizon") == h, F.col(metric)))
    g = m.where(F.col("horizon").isin(a, b)).groupBy(*by).agg(pick(a).alias("value_a"), pick(b).alias("value_b"))
    return g.withColumns({"difference": F.col("value_b") - F.col("value_a"), "ratio": F.try_divide(F.col("value_b"), F.col("value_a"))})


def performance_patterns(df: DataFrame, t: str = "ts", by: Sequence[str] = ("model",)) -> DataFrame:
    """MAPE by season, by area and by month of each model, long."""
    base = df.groupBy(*by, "area", F.month(t).alias("__m"), season_number(F.col(t)).alias("__s")).agg(*_partials())
    cells = F.array(
        F.struct(F.lit("season").alias("kind"), F.col("__s").cast("string").alias("value")),
        F.struct(F.lit("area").alias("kind"), F.col("area").alias("value")),
        F.struct(F.lit("month").alias("kind"), F.col("__m").cast("string").alias("value")),
    )
    x = base.withColumn("c", F.explode(cells)).select(*by, "c.*", "n", "s_ape", "s_ae")
    return x.groupBy(*by, "kind", "value").agg(
        F.sum("n").alias("n"), (100 * F.sum("s_ape") / F.sum("n")).alias("smape"), (F.sum("s_ae") / F.sum("n")).alias("mae"))


def metric_stability(m: DataFrame, by: Sequence[str], value: str = "smape") -> DataFrame:
    return m.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.try_divide(F.stddev_pop(value), F.avg(value)).alias("cv"), (F.max(value) - F.min(value)).alias("range"), F.count(value).alias("n"),
    )


def tolerance_check(m: DataFrame, ref: DataFrame, keys: Sequence[str], metric: str, tol: float = 0.02) -> DataFrame:
    r = ref.select(*keys, F.col(metric).alias("__ref"))
    rel = F.abs(F.col(metric) - F.col("__ref")) / F.greatest(F.abs(F.col("__ref")), F.lit(EPS))
    return m.join(r, list(keys)).select(*keys, metric, F.col("__ref").alias("reference"), rel.alias("relative_difference"), (rel <= tol).alias("within_tolerance"))


def baseline_compare(sys: DataFrame, base: DataFrame, tol: float = 2.0, keys: Sequence[str] = ("area", "model"), metric: str = "smape") -> DataFrame:
    from wattline.operators.joins import join_baseline

    d = F.col(metric) - F.col(f"baseline_{metric}")
    return join_baseline(sys, base, keys, [metric]).select(
        *keys, metric, f"baseline_{metric}", d.alias("difference"), (d <= tol).alias("within_tolerance"))


def baseline_summary(cmp: DataFrame) -> DataFrame:
    d = F.col("difference")
    return cmp.agg(
        F.avg(d).alias("mean_difference"), F.stddev_pop(d).alias("std_difference"), F.max(d).alias("max_difference"),
        F.min(d).alias("min_difference"), F.avg(F.col("within_tolerance").cast("double")).alias("pass_rate"),
        F.count(F.lit(1)).alias("total_comparisons"), F.count_if(~F.col("within_tolerance")).alias("violations"),
    )

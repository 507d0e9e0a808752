"""Forecast combination: means, weights, best model, stacking, state- and context-based."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.moments import correlation
from wattline.functions.ordered import bounded, ema, stable
from wattline.operators.folds import time_folds
from wattline.operators.joins import pivot_models

KEYS = ("ts", "area", "horizon")
# Performance states with their upper MAPE limits and weight multipliers.
STATE_LIMITS = (("excellent", 2.0), ("good", 4.0), ("fair", 8.0))
STATE_WEIGHT = {"excellent": 4.0, "good": 2.0, "fair": 1.0, "poor": 0.5}


def combine_mean(fc: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return fc.groupBy(*keys).agg(F.avg("yhat").alias("yhat"), F.count("yhat").alias("n_models"))


def combine_weighted(fc: DataFrame, weights: DataFrame, keys: Sequence[str] = KEYS, cols: Sequence[str] = ("yhat",)) -> DataFrame:
    """Weights renormalised over the models that have a value in the row."""
    on = [c for c in weights.columns if c != "weight"]
    j = fc.join(weights, on)
    w = lambda c: F.when(F.col(c).isNotNull(), F.col("weight"))
    return j.groupBy(*keys).agg(*[F.try_divide(F.sum(w(c) * F.col(c)), F.sum(w(c))).alias(c) for c in cols])


def normalize_weights(w: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    s = w.groupBy(*by).agg(F.sum("weight").alias("__s"))
    j = w.join(s, list(by)) if by else w.join(s)  # one row
    return j.withColumn("weight", F.try_divide(F.col("weight"), F.col("__s"))).drop("__s")


def check_weights(w: DataFrame, by: Sequence[str] = (), tol: float = 1e-6) -> DataFrame:
    a = w.groupBy(*by).agg(F.sum("weight").alias("total"), F.min("weight").alias("smallest"))
    return a.withColumn("ok", (F.abs(F.col("total") - 1) <= tol) & (F.col("smallest") >= 0))


def combine_intervals(fc: DataFrame, weights: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return combine_weighted(fc, weights, keys, ["lo", "hi"])


def contributions(fc: DataFrame, weights: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Contribution per model, dominant model and entropy of the weights."""
    j = fc.where("yhat is not null").join(weights, [c for c in weights.columns if c != "weight"])
    c = F.col("weight") * F.col("yhat")
    return j.groupBy(*keys).agg(
        F.sum(c).alias("combined"), F.max_by("model", F.struct(F.col("weight"), F.col("model"))).alias("dominant_model"),
        (-F.sum(F.col("weight") * F.ln(F.col("weight") + 1e-10))).alias("weight_entropy"))


def weights_inverse_error(df: DataFrame, by: Sequence[str] = (), sparsity: float = 0.0) -> DataFrame:
    """1 / MAE, normalised; weights under ``sparsity`` dropped and the rest renormalised."""
    e = df.groupBy(*by, "model").agg((1 / F.greatest(F.avg(F.abs(F.col("y") - F.col("yhat"))), F.lit(1e-10))).alias("weight"))
    w = normalize_weights(e, by)
    return normalize_weights(w.where(F.col("weight") >= sparsity), by) if sparsity else w


def error_gram(df: DataFrame, models: Sequence[str], keys: Sequence[str] = KEYS) -> tuple[int, np.ndarray]:
    """(rows, mean of error products) over the rows where every model and the target exist."""
    wide = pivot_models(df, models, keys, keep=["y"]).dropna()
    e = {m: F.col("y") - F.col(m) for m in models}
    aggs = [F.avg(e[a] * e[b]).alias(f"g{i}_{j}") for i, a in enumerate(models) for j, b in enumerate(models) if i <= j]
    row = wide.agg(F.count(F.lit(1)).alias("n"), *aggs).head()
    g = np.zeros((len(models),) * 2)
    for i in range(len(models)):
        for j in range(i, len(models)):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"]
    return row["n"], g


def _project(w: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Nearest point with sum 1 inside the bounds."""
    a, b = (w - hi).min() - 1, (w - lo).max() + 1
    for _ in range(100):
        m = (a + b) / 2
        a, b = (m, b) if np.clip(w - m, lo, hi).sum() > 1 else (a, m)
    return np.clip(w - (a + b) / 2, lo, hi)


def weights_min_mse(df: DataFrame, models: Sequence[str], bounds: tuple[float, float] = (0.0, 1.0), l2: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """The data are reduced to an m x m table of error products; m is the number of models."""
    _, g = error_gram(df, models, keys)
    q = g + l2 * np.trace(g) / len(g) * np.eye(len(g))
    w = np.full(len(models), 1 / len(models))
    lr = 1.0 / np.linalg.eigvalsh(q)[-1]
    ahead, t = w, 1.0
    while True:  # accelerated projected gradient, restarted where it turns back; ends at the minimum
        nxt = _project(ahead - lr * (q @ ahead), *bounds)
        t2 = 1.0 if (ahead - nxt) @ (nxt - w) > 0 else (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = np.abs(nxt - _project(nxt - lr * (q @ nxt), *bounds)).max()
        ahead, w, t = nxt + (t - 1) / t2 * (nxt - w) * (t2 > 1), nxt, t2
        if moved < 1e-10:
            break
    return df.sparkSession.createDataFrame([(m, float(x)) for m, x in zip(models, w, strict=True)], "model string, weight double")


def lowest_mix(cuts: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (sum 1, none negative) with the smallest maximum of ``cuts @ weights``, and that maximum.

    With all entries shifted above zero this is: maximise sum(u) with cuts @ u <= 1; u / sum(u) are the weights.
    """
    shift = 1.0 + max(0.0, -cuts.min()) + np.ptp(cuts)
    rows, m = cuts.shape
    size = (cuts + shift).max()
    t = np.zeros((rows + 1, m + rows + 1))
    t[:rows, :m], t[:rows, m:-1], t[:rows, -1] = (cuts + shift) / size, np.eye(rows), 1.0
    t[-1, :m] = -1.0
    basis = list(range(m, m + rows))
    for step in range(50 * (m + rows)):
        worse = np.flatnonzero(t[-1, :-1] < -1e-12)
        if not len(worse):
            break
        c = worse[np.argmin(t[-1, worse])] if step < 10 * (m + rows) else worse[0]  # the first one cannot cycle
        up = t[:rows, c] > 1e-12
        r = int(np.argmin(np.where(up, t[:rows, -1] / np.where(up, t[:rows, c], 1.0), np.inf)))
        t[r] /= t[r, c]
        others = np.arange(rows + 1) != r
        t[others] -= np.outer(t[others, c], t[r])
        basis[r] = int(c)
    u = np.zeros(m + rows)
    u[basis] = t[:rows, -1]
    w = np.maximum(u[:m], 0)
    w /= w.sum()
    return w, float((cuts @ w).max())


def min_mae_rounds(df: DataFrame, models: Sequence[str], keys: Sequence[str] = KEYS, gap: float = 1e-7, rounds: int = 500) -> tuple[DataFrame, DataFrame]:
    """Weights of the convex combination with the smallest mean absolute error, and (mae, bound, rounds).

    Cutting planes: the error at a point and its subgradient (two kinds of sums over all rows, one
    aggregate a round) bound the error at every other point from below. The next point is the one
    with the lowest bound; a second one halfway to the best point so far keeps it from
    swinging. Ends when error and bound are within ``gap`` of each other, relatively.
    """
    models = list(models)
    wide = stable(pivot_models(df, models, keys, keep=["y"]).dropna().select(F.col("y").cast("double").alias("y"), *[F.col(m).cast("double").alias(f"x{i}") for i, m in enumerate(models)]))
    x = [F.col(f"x{i}") for i in range(len(models))]
    cuts, best, best_w, bound, n = [], np.inf, np.full(len(models), 1 / len(models)), -np.inf, 0
    points = [best_w]
    while n < rounds:
        n += 1
        aggs = []
        for p, w in enumerate(points):
            e = sum((float(a) * c for a, c in zip(w, x, strict=True)), F.lit(0.0)) - F.col("y")
            aggs += [F.avg(F.abs(e)).alias(f"f{p}"), *[F.avg(F.signum(e) * c).alias(f"g{p}_{i}") for i, c in enumerate(x)]]
        row = wide.agg(*aggs).head()
        if row["f0"] is None:
            raise ValueError("no row has a value of every model")
        for p, w in enumerate(points):
            g = np.array([row[f"g{p}_{i}"] for i in range(len(models))])
            cuts.append(row[f"f{p}"] - g @ w + g)  # the cut's height at each corner of the simplex
            if row[f"f{p}"] < best:
                best, best_w = row[f"f{p}"], w
        low, value = lowest_mix(np.array(cuts))
        bound = max(bound, value)
        if best - bound <= gap * max(best, 1e-300):
            break
        points = [low, (low + best_w) / 2]
    spark = df.sparkSession
    return (
        spark.createDataFrame([(m, float(v)) for m, v in zip(models, best_w, strict=True)], "model string, weight double"),
        spark.createDataFrame([(float(best), float(bound), n)], "mae double, bound double, rounds int"),
    )


def weights_min_mae(df: DataFrame, models: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return min_mae_rounds(df, models, keys)[0]


# --- stacking --------------------------------------------------------------------
LEARNERS = {
    "linear": lambda: LinearRegression(), "ridge": lambda: LinearRegression(regParam=1.0, elasticNetParam=0.0),
    "lasso": lambda: LinearRegression(regParam=0.1, elasticNetParam=1.0), "elastic_net": lambda: LinearRegression(regParam=0.1, elasticNetParam=0.5),
    "forest": lambda: RandomForestRegressor(numTrees=20, seed=42), "boosted": lambda: GBTRegressor(maxIter=20, seed=42),
}


def _meta(df: DataFrame, models: Sequence[str], keep: Sequence[str] = ("y",)) -> DataFrame:
    wide = pivot_models(df, models, KEYS, keep=list(keep))
    return VectorAssembler(inputCols=list(models), outputCol="features").transform(wide.dropna(subset=list(models)))


def stack_fit(df: DataFrame, models: Sequence[str], horizons: Sequence[int], learner: str = "ridge", folds: int = 0) -> tuple[dict, list]:
    """(horizon -> fitted meta model, fold scores); rows lacking a model are left out."""
    fitted, scores = {}, []
    meta = _meta(df, models).where("y is not null").withColumnRenamed("y", "label")
    for h in horizons:
        x = meta.where(F.col("horizon") == h)
        if folds:
            f = time_folds(x, folds)
            for k in range(1, folds + 1):
                m = LEARNERS[learner]().fit(f.where(F.col("fold") < k))
                e = m.transform(f.where(F.col("fold") == k)).agg(F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)))).head()[0]
                scores.append((h, k, float(e)))
        fitted[h] = LEARNERS[learner]().fit(x)
    return fitted, scores


def stack_apply(fitted: Mapping, df: DataFrame, models: Sequence[str]) -> DataFrame:
    meta, out = _meta(df, models, keep=["y"] if "y" in df.columns else []), None
    for h, m in fitted.items():
        p = m.transform(meta.where(F.col("horizon") == h)).select(*KEYS, F.col("prediction").alias("yhat"), *(["y"] if "y" in df.columns else []))
        out = p if out is None else out.unionByName(p)
    return out


def stack_weights(spark, fitted: Mapping, models: Sequence[str]) -> DataFrame:
    rows = []
    for h, m in fitted.items():
        a = np.abs(m.coefficients.toArray() if hasattr(m, "coefficients") else m.featureImportances.toArray())
        a = a / a.sum() if a.sum() > 0 else np.full(len(a), 1 / len(a))
        rows += [(h, n, float(v)) for n, v in zip(models, a, strict=True)]
    return spark.createDataFrame(rows, "horizon int, model string, weight double")


# --- best model ------------------------------------------------------------------
def selection_metrics(df: DataFrame, by: Sequence[str] = (), weights: Mapping[str, float] | None = None) -> DataFrame:
    y, e = F.col("y"), F.col("y") - F.col("yhat")
    m = df.groupBy(*by, "model").agg(
        (100 * F.avg(F.abs(e / (F.abs(y) + 1e-8)))).alias("mape"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y) + 1e-8)).alias("r2"))
    w = weights or {"mape": 0.4, "mae": 0.3, "rmse": 0.3}
    return m.withColumn("combined", sum((F.col(k) * v for k, v in w.items()), F.lit(0.0)))


CRITERIA = {"min_mape": ("mape", False), "min_mae": ("mae", False), "min_rmse": ("rmse", False), "max_r2": ("r2", True), "min_combined": ("combined", False)}


def rank_by(m: DataFrame, criterion: str, by: Sequence[str] = ()) -> DataFrame:
    c, down = CRITERIA[criterion]
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.col(c).desc() if down else F.col(c), "model")  # one row per model
    return m.withColumn("rank", F.row_number().over(w))


def best_model(df: DataFrame, criterion: str = "min_mape") -> DataFrame:
    return rank_by(selection_metrics(df), criterion)


def best_per_horizon(df: DataFrame, criterion: str = "min_mape") -> DataFrame:
    return rank_by(selection_metrics(df, ["horizon"]), criterion, ["horizon"]).where("rank = 1")


def combine_best(fc: DataFrame, ranking: DataFrame, fallback: str = "next_best", keys: Sequence[str] = KEYS) -> DataFrame:
    """Best-ranked model; where it is absent: next ranked, mean of the rest, or an error."""
    on = [c for c in ("model", "horizon") if c in ranking.columns]
    j = fc.join(ranking.select(*on, "rank"), on)
    has = F.col("yhat").isNotNull()
    g = j.groupBy(*keys).agg(
        F.max(F.when(has & (F.col("rank") == 1), F.col("yhat"))).alias("__b"), F.min_by("yhat", F.when(has, F.col("rank"))).alias("__n"), F.avg("yhat").alias("__m"))
    alt = {"next_best": F.col("__n"), "simple_average": F.col("__m"), "error": F.raise_error("best model has no forecast").cast("double")}[fallback]
    return g.select(*keys, F.coalesce("__b", alt).alias("yhat"))


# --- performance states ----------------------------------------------------------
def state_of(mape: Column, limits: Sequence[tuple[str, float]] = STATE_LIMITS) -> Column:
    """State by upper limits. The value is rounded first: a mean that lies on a limit must not
    depend on the order in which tasks add it up."""
    mape = F.round(mape, 9)
    c = F.when(mape.isNull(), F.lit(None))
    for name, lim in limits:
        c = c.when(mape < lim, name)
    return c.otherwise("poor")


def perf_states(df: DataFrame, keys: Sequence[str] = ("ts", "area", "model"), limits: Sequence[tuple[str, float]] = STATE_LIMITS) -> DataFrame:
    ape = F.when(F.col("y") != 0, 100 * F.abs((F.col("y") - F.col("yhat")) / F.col("y")))
    return df.groupBy(*keys).agg(F.avg(ape).alias("mape")).where("mape is not null").withColumn("state", state_of(F.col("mape"), limits))


def transitions(states: DataFrame, series: Sequence[str] = ("area", "model"), step: int | None = None) -> DataFrame:
    s = bounded(states, series, "ts", lambda w: {"from_state": F.lag("state").over(w)}, back=1, step=step)
    c = s.where("from_state is not null").groupBy("model", "from_state", F.col("state").alias("to_state")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("probability", F.col("n") / F.sum("n").over(Window.partitionBy("model", "from_state")))  # four rows


def next_state(states: DataFrame, trans: DataFrame, series: Sequence[str] = ("area", "model")) -> DataFrame:
    last = states.groupBy(*series).agg(F.max_by("state", "ts").alias("from_state"))
    return last.join(trans.drop("n"), ["model", "from_state"])


def markov_weights(states: DataFrame, window: int = 48, step: int | None = None, by: Sequence[str] = ("ts", "area"), limits: Sequence[tuple[str, float]] = STATE_LIMITS) -> DataFrame:
    """Multiplier of the state over (rolling MAPE + 1); a model without history weighs 1."""
    r = bounded(states, ["area", "model"], "ts", lambda w: {"rolling": F.avg("mape").over(w.rowsBetween(-window, -1))}, back=window, step=step)
    mult = F.when(state_of(F.col("rolling"), limits) == "excellent", STATE_WEIGHT["excellent"])
    for s in ("good", "fair"):
        mult = mult.when(state_of(F.col("rolling"), limits) == s, STATE_WEIGHT[s])
    raw = F.when(F.col("rolling").isNull(), 1.0).otherwise(mult.otherwise(STATE_WEIGHT["poor"]) / (F.col("rolling") + 1))
    return normalize_weights(r.select(*by, "model", raw.alias("weight")), by)


def smooth_weights(w: DataFrame, alpha: float = 0.3, by: Sequence[str] = ("ts", "area")) -> DataFrame:
    """Smoothing along time per model, then the weights of each row renormalised."""
    series = [c for c in by if c != "ts"] + ["model"]
    s = ema(w, series, "ts", "weight", alpha, "__s").drop("weight").withColumnRenamed("__s", "weight")
    return normalize_weights(s, by)


# --- context ---------------------------------------------------------------------
def row_weights(df: DataFrame, keys: Sequence[str] = ("ts", "area"), eps: float = 1e-3) -> DataFrame:
    """Inverse absolute error weights of every row: the training target of the context model."""
    e = df.groupBy(*keys, "model").agg((1 / (F.avg(F.abs(F.col("y") - F.col("yhat"))) + eps)).alias("weight"))
    return normalize_weights(e, keys)


def context_weights_fit(df: DataFrame, ctx: DataFrame, features: Sequence[str], models: Sequence[str], depth: int = 4):
    x = VectorAssembler(inputCols=list(features), outputCol="features").transform(
        row_weights(df).join(ctx.select("ts", "area", *features), ["ts", "area"]).dropna())
    x = x.withColumnRenamed("weight", "label").persist()
    fitted = {m: RandomForestRegressor(numTrees=10, maxDepth=depth, seed=42).fit(x.where(F.col("model") == m)) for m in models}
    x.unpersist()
    return fitted


def context_weights_apply(fitted: Mapping, ctx: DataFrame, features: Sequence[str], lo: float = 0.0, hi: float = 1.0, alpha: float | None = None) -> DataFrame:
    x = VectorAssembler(inputCols=list(features), outputCol="features").transform(ctx.select("ts", "area", *features).dropna())
    out = None
    for name, m in fitted.items():
        w = F.greatest(F.least(F.col("prediction"), F.lit(hi)), F.lit(lo))
        p = m.transform(x).select("ts", "area", F.lit(name).alias("model"), w.alias("weight"))
        out = p if out is None else out.unionByName(p)
    out = normalize_weights(out, ["ts", "area"])
    return smooth_weights(out, alpha) if alpha else out


def context_relationships(ctx: DataFrame, w: DataFrame, features: Sequence[str], k: int = 5) -> DataFrame:
    """Correlation of each feature with each model's weight, top ``k`` per model, and weight std."""
    wide = w.join(ctx.select("ts", "area", *[F.col(f).cast("double").alias(f) for f in features]), ["ts", "area"])
    a = wide.groupBy("model").agg(F.stddev_samp("weight").alias("weight_std"), *[correlation(f, "weight").alias(f) for f in features])
    long = a.unpivot(["model", "weight_std"], list(features), "feature", "correlation").where("correlation is not null and not isnan(correlation)")
    r = F.row_number().over(Window.partitionBy("model").orderBy(F.abs("correlation").desc(), "feature"))  # one row per feature
    return long.withColumn("rank", r).where(F.col("rank") <= k)

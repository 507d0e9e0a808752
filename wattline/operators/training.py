"""Tree models over horizons, tuning, and the batch jobs.

``train_areas``, ``train_all``, ``tune`` and ``train_job`` fit a model of its own for every area, all of them in
one pass per tree level (``boosting.py``); folds and grid points are further runs of the same pass.
``train_gbt`` and ``train_rf`` fit one MLlib model over all areas (``area_index`` as a feature).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.operators import boosting as B
from wattline.operators.folds import beside, dealt, time_folds
from wattline.operators.joins import horizon_target
from wattline.operators.metrics import metrics
from wattline.operators.selection import safe_features
from wattline.sources.readers import write_forecasts


def _vector(df: DataFrame, features: Sequence[str]) -> DataFrame:
    cast = df.withColumns({f"__f_{f}": F.col(f).cast("double") for f in features})
    return VectorAssembler(inputCols=[f"__f_{f}" for f in features], outputCol="features", handleInvalid="skip").transform(cast).drop(*[f"__f_{f}" for f in features])


def index_areas(df: DataFrame, by: str = "area"):
    return StringIndexer(inputCol=by, outputCol="area_index", stringOrderType="alphabetAsc").fit(df.select(by))


def train_gbt(df: DataFrame, features: Sequence[str], target: str, iters: int = 20, depth: int = 5, **kw):
    """One MLlib model for all areas together."""
    x = _vector(df.where(F.col(target).isNotNull()), features)
    return GBTRegressor(labelCol=target, maxIter=iters, maxDepth=depth, seed=42, **kw).fit(x)


def predict_gbt(model, df: DataFrame, features: Sequence[str], horizon: int, by: str = "area") -> DataFrame:
    return model.transform(_vector(df, features)).select(by, "ts", F.lit(horizon).alias("horizon"), F.col("prediction").alias("yhat"))


def cv_score_pooled(df: DataFrame, features: Sequence[str], target: str, folds: int, **kw) -> DataFrame:
    """(area, fold, n, mae) of the all-area model on time-ordered folds."""
    return _cv_pooled(dealt(time_folds(df, folds)), features, target, folds, [kw])[0]


def _cv_pooled(f: DataFrame, features: Sequence[str], target: str, folds: int, settings: Sequence[Mapping]) -> list[DataFrame]:
    """``cv_score_pooled`` of every setting on one table with folds; the fits run beside each other."""
    def score(at: tuple[int, int]) -> DataFrame:
        i, k = at
        m = train_gbt(f.where(F.col("fold") < k), features, target, **settings[i])
        p = m.transform(_vector(f.where((F.col("fold") == k) & F.col(target).isNotNull()), features))
        return p.groupBy("area").agg(F.lit(k).alias("fold"), F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(target) - F.col("prediction"))).alias("mae"))

    made = beside(f.sparkSession, score, product(range(len(settings)), range(1, folds + 1)))
    return [reduce(DataFrame.unionByName, made[i * folds:(i + 1) * folds]) for i in range(len(settings))]


def train_pooled(df: DataFrame, features: Sequence[str], target: str, folds: int = 3, **kw) -> tuple:
    """One fit over all areas with the area index as a feature, and the MAE per area from the folds."""
    x = index_areas(df).transform(df)
    cols, f = [*features, "area_index"], dealt(time_folds(x, folds))
    score, model = beside(f.sparkSession, lambda make: make(), [
        lambda: _cv_pooled(f, cols, target, folds, [kw])[0], lambda: train_gbt(f.drop("fold"), cols, target, **kw)])
    return model, score.groupBy("area").agg(F.avg("mae").alias("cv_mae"), F.sum("n").alias("n"))


def tune_pooled(df: DataFrame, features: Sequence[str], target: str, grid: Mapping[str, Sequence], folds: int = 2) -> DataFrame:
    """Every grid point scored on the time folds by the all-area model, best first."""
    points = [dict(zip(grid, vals, strict=True)) for vals in product(*grid.values())]
    scores = _cv_pooled(dealt(time_folds(df, folds)), features, target, folds, points)
    rows = [(str(kw), float(s.agg((F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("m")).head()[0])) for kw, s in zip(points, scores, strict=True)]
    return df.sparkSession.createDataFrame(rows, "params string, mae double").orderBy("mae", "params")


def train_job_pooled(df: DataFrame, features: Sequence[str], target: str, folds: int = 2, **kw) -> DataFrame:
    """fit -> predict the training rows -> report per area, with the fold MAE, by the all-area model."""
    model, cv = train_pooled(df, features, target, folds, **kw)
    x = index_areas(df).transform(df)
    p = predict_gbt(model, x, [*features, "area_index"], 1).join(x.select("area", "ts", F.col(target).alias("y")), ["area", "ts"]).where("y is not null")
    return metrics(p, ["area"], symmetric=False).join(cv.select("area", "cv_mae"), "area", "left")


def train_areas(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ("area",), **settings) -> B.Boosted:
    """A boosted model for every area."""
    return B.boost(df, features, target, by, runs={"all": settings})


def predict_areas(model: B.Boosted, df: DataFrame, horizon: int, run: str = "all") -> DataFrame:
    return B.predict(model, df, run).select(*model.by, "ts", F.lit(horizon).alias("horizon"), "yhat")


def train_rf(df: DataFrame, target: str, features: Sequence[str], horizons: Sequence[int], ppd: int = 48, step: int | None = None, trees: int = 20, depth: int = 6) -> dict:
    """horizon -> (model, features that are safe for it), target shifted by horizon x ppd rows."""
    out = {}
    for h in horizons:
        safe = safe_features(features, h, ppd, f"target_h{h}")
        x = _vector(dealt(horizon_target(df, h, ppd, y=target, step=step).where(F.col(f"target_h{h}").isNotNull())), safe)
        out[h] = (RandomForestRegressor(labelCol=f"target_h{h}", numTrees=trees, maxDepth=depth, seed=42).fit(x), safe)
    return out


def predict_rf(models: Mapping, df: DataFrame, by: str = "area", z: float = 1.96) -> DataFrame:
    """Mean and spread over the trees. Each tree adds one column, so rows are not multiplied."""
    out = None
    for h, (m, feats) in models.items():
        x = _vector(df, feats).select(by, "ts", "features")
        for i, tree in enumerate(m.trees):
            x = tree.setPredictionCol(f"__t{i}").transform(x)
        v = F.array(*[F.col(f"__t{i}") for i in range(len(m.trees))])
        n = len(m.trees)
        mean = F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / n
        x = x.select(by, "ts", v.alias("v"), mean.alias("yhat"))
        sd = F.sqrt(F.aggregate(F.transform("v", lambda e: (e - F.col("yhat")) * (e - F.col("yhat"))), F.lit(0.0), lambda a, b: a + b) / n)
        p = x.select(by, "ts", F.lit(h).alias("horizon"), "yhat", sd.alias("std")).withColumns({"lo": F.col("yhat") - z * F.col("std"), "hi": F.col("yhat") + z * F.col("std")})
        out = p if out is None else out.unionByName(p)
    return out


def train_all(df: DataFrame, features: Sequence[str], target: str, folds: int = 3, by: Sequence[str] = ("area",), **settings) -> tuple[B.Boosted, DataFrame]:
    """A model for every area, and the MAE of each on time-ordered folds: (area, cv_mae, n)."""
    model = B.boost(time_folds(df, folds, by=by), features, target, by, runs=B.fold_runs(folds, **settings), fold="fold")
    return model, B.fold_errors(model).groupBy(*by).agg(F.avg("mae").alias("cv_mae"), F.sum("n").alias("n"))


def tune(df: DataFrame, features: Sequence[str], target: str, grid: Mapping[str, Sequence], folds: int = 2, by: Sequence[str] = ("area",), **settings) -> DataFrame:
    """Every grid point scored on the time folds of every area, best first: (params, mae). All points and folds grow in one pass."""
    points = [dict(zip(grid, vals, strict=True)) for vals in product(*grid.values())]
    runs = {f"{i}:{k}": {**settings, **p, "train_before": k} for i, p in enumerate(points) for k in range(1, folds + 1)}
    model = B.boost(time_folds(df, folds, by=by), features, target, by, runs=runs, fold="fold")
    names = F.array(*[F.lit(", ".join(f"{k}={v}" for k, v in p.items())) for p in points])
    params = F.element_at(names, F.split("run", ":")[0].cast("int") + 1).alias("params")
    return B.fold_errors(model).groupBy(params).agg((F.sum(F.col("mae") * F.col("n")) / F.sum("n")).alias("mae")).orderBy("mae", "params")


def model_report(df: DataFrame, by: Sequence[str] = ("area", "model")) -> DataFrame:
    e = F.col("y") - F.col("yhat")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean_error"), F.stddev_samp(e).alias("std_error"), F.avg(F.abs(e)).alias("mae"),
        F.max(F.abs(e)).alias("max_error"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def predict_job(fc: DataFrame, edges: DataFrame, root: str, path: str | None = None, fmt: str = "parquet", level: int = 95,
                keys: Sequence[str] = ("ts", "horizon")) -> DataFrame:
    """node forecasts -> proportional reconciliation -> intervals -> sink."""
    from wattline.operators.profiles import simple_intervals
    from wattline.operators.reconcile import reconcile_proportional

    out = simple_intervals(reconcile_proportional(fc, edges, root, keys), level)
    if path:
        write_forecasts(out, path, fmt)
    return out


def train_job(df: DataFrame, features: Sequence[str], target: str, folds: int = 2, by: Sequence[str] = ("area",), **settings) -> DataFrame:
    """fit -> predict the training rows -> report per area, with the fold MAE."""
    model, cv = train_all(df, features, target, folds, by, **settings)
    p = model.fitted.where("run = 'all'").select(*by, "ts", F.col("target").alias("y"), "yhat")
    return metrics(p, list(by), symmetric=False).join(cv.select(*by, "cv_mae"), list(by), "left")

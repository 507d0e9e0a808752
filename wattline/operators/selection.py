"""Leakage filter, feature importance and feature selection."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.moments import correlation
from wattline.functions.ordered import quantiles, stable
from wattline.operators.folds import beside, dealt, time_folds

# Name parts that point at the future.
LEAK_WORDS = ["future", "forward", "actual", "target"]


def _leak_reason(name: str, h: int, ppd: int, target: str) -> str | None:
    low = name.lower()
    if name == target:
        return "target"
    if any(w in low for w in LEAK_WORDS):
        return "name"
    m = re.search(r"lag[_-](\d+)", low)
    return "lag" if m and int(m.group(1)) < h * ppd else None


def safe_features(cols: Sequence[str], h: int, ppd: int = 48, target: str = "target") -> list[str]:
    """Known from column names alone, so unsafe columns are never read."""
    return [c for c in cols if _leak_reason(c, h, ppd, target) is None]


def leakage_report(spark: SparkSession, cols: Sequence[str], h: int, ppd: int = 48, target: str = "target") -> DataFrame:
    rows = [(c, h, _leak_reason(c, h, ppd, target)) for c in cols]
    return spark.createDataFrame(rows, "feature string, horizon int, reason string").withColumn("is_safe", F.col("reason").isNull())


def leakage_check(df: DataFrame, features: Sequence[str], target: str, h: int, ppd: int = 48, near: float = 0.999) -> DataFrame:
    """The report with what the table says, from one aggregate: rows that have feature and target, their
    correlation, and a warning for a feature that isn't known yet or nearly equals the target."""
    cells = []
    for c in features:
        reason = _leak_reason(c, h, ppd, target)
        x, y = F.col(c).cast("double"), F.col(target).cast("double")
        cells.append(F.struct(
            F.lit(c).alias("feature"), F.lit(h).alias("horizon"), F.lit(reason).cast("string").alias("reason"), F.lit(reason is None).alias("is_safe"),
            F.count_if(x.isNotNull() & y.isNotNull()).alias("n"), correlation(x, y).alias("correlation")))
    rows = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    late = F.when(F.col("reason").isNotNull(), F.lit(f"not known at horizon {h}"))
    return rows.withColumn("warning", late.when(F.abs("correlation") >= near, F.lit("nearly equals the target")))


def _assembled(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    keep = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("label")).dropna()
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(keep)


def forest_importance(df: DataFrame, features: Sequence[str], target: str, trees: int = 20, depth: int = 5, seed: int = 42):
    model = RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed).fit(_assembled(df, features, target))
    return model, list(zip(features, model.featureImportances.toArray().tolist(), strict=True))


def _table(spark: SparkSession, rows, horizon: int) -> DataFrame:
    return spark.createDataFrame([(f, float(v), horizon) for f, v in rows], "feature string, importance double, horizon int")


def select_by_importance(df: DataFrame, target: str, features: Sequence[str], h: int = 1, threshold: float = 0.01,
                         max_features: int = 50, min_features: int = 10, ppd: int = 48, **kw) -> DataFrame:
    """Safe features above the threshold, at most ``max_features``, at least the top ``min_features``."""
    safe = safe_features(features, h, ppd, target)
    _, imp = forest_importance(df, safe, target, **kw)
    imp.sort(key=lambda r: (-r[1], r[0]))
    kept = [r for r in imp if r[1] >= threshold][:max_features]
    if len(kept) < min_features:
        kept = imp[:min_features]
    return _table(df.sparkSession, kept, h)


def _rank_columns(df: DataFrame, features: Sequence[str], target: str, folds: int, t: str, by: Sequence[str], **kw):
    """(mean MAE over the time folds, importance) of one feature set."""
    def score(k: int) -> tuple:
        model, imp = forest_importance(df.where(F.col("fold") < k), features, target, **kw)
        test = _assembled(df.where(F.col("fold") == k), features, target)
        return RegressionEvaluator(metricName="mae").evaluate(model.transform(test)), imp

    scored = beside(df.sparkSession, score, range(1, folds + 1))
    return sum(s[0] for s in scored) / folds, scored[-1][1]


def select_rfe(df: DataFrame, target: str, features: Sequence[str], folds: int = 3, min_features: int = 5, drop_share: float = 0.3,
               by: Sequence[str] = ("area",), t: str = "ts", h: int = 1, **kw) -> DataFrame:
    """Shrinking feature sets, each scored on time-ordered folds; the best set is returned."""
    f = dealt(time_folds(df, folds, 0, t, by), [*by, t])
    cur, best = list(features), None
    while True:
        mae, imp = _rank_columns(f, cur, target, folds, t, by, **kw)
        if best is None or mae <= best[0]:
            best = (mae, imp)
        if len(cur) <= min_features:
            break
        imp = sorted(imp, key=lambda r: -r[1])
        cur = [n for n, _ in imp[: max(min_features, int(len(cur) * (1 - drop_share)))]]
    f.unpersist()
    return _table(df.sparkSession, best[1], h)


def shuffled_columns(df: DataFrame, columns: Sequence[str], key: Sequence[str], seed: int) -> DataFrame:
    """Adds ``__other``: the columns of another row, so that each is permuted over all rows.

    Rows are numbered in two hash orders, in blocks whose number follows from the number of rows;
    one join takes row k of the second order to row k of the first.
    """
    from pyspark.sql import Window

    from wattline.functions.ordered import VALUE_ROWS, uniform

    b = stable(df.withColumns({"__u": uniform(seed, *key), "__v": uniform(seed + 1, *key), "__h": F.xxhash64(*key)}))
    blocks = -(-b.count() // VALUE_ROWS) or 1

    def ranked(order: str) -> DataFrame:
        blk = b.withColumn("__blk", F.floor(F.col(order) * blocks))
        tot = blk.groupBy("__blk").agg(F.count(F.lit(1)).alias("__c"))
        off = tot.withColumn("__off", F.sum("__c").over(Window.orderBy("__blk")) - F.col("__c")).drop("__c")  # one row per block
        r = F.row_number().over(Window.partitionBy("__blk").orderBy(order, "__h")) + F.col("__off")
        return blk.join(off, "__blk").withColumn("__r", r).drop("__blk", "__off")

    others = ranked("__v").select("__r", F.struct(*columns).alias("__other"))
    return ranked("__u").join(others, "__r").drop("__r", "__u", "__v", "__h")


def permutation_importance(model, df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], repeats: int = 10,
                           seed: int = 42, threshold: float | None = None, h: int = 1) -> DataFrame:
    """Rise of the mean squared error when one column is permuted."""
    ev = RegressionEvaluator(metricName="mse")
    base_df = stable(df.select(*key, *features, target).dropna())
    base = ev.evaluate(model.transform(_assembled(base_df, features, target)))
    total = dict.fromkeys(features, 0.0)
    for r in range(repeats):
        s = stable(shuffled_columns(base_df, features, key, seed + 2 * r))
        for f in features:
            one = s.withColumn(f, F.col("__other").getField(f))
            total[f] += ev.evaluate(model.transform(_assembled(one, features, target))) - base
    rows = [(f, t / repeats) for f, t in total.items()]
    return _table(df.sparkSession, [r for r in rows if threshold is None or r[1] >= threshold], h)


def select_combined(a: DataFrame, b: DataFrame, cap: int = 50) -> DataFrame:
    """Features of either method with the mean of their importances; agreed ones first."""
    j = a.select("feature", "horizon", F.col("importance").alias("a")).join(
        b.select("feature", "horizon", F.col("importance").alias("b")), ["feature", "horizon"], "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    j = j.select("feature", "horizon", both.alias("in_both"),
                 ((F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) / (F.when(both, 2).otherwise(1))).alias("importance"))
    return j.orderBy(F.col("in_both").desc(), F.col("importance").desc(), "feature").limit(cap)


def selection_report(imp: DataFrame) -> DataFrame:
    return imp.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n_features"), F.max_by("feature", F.struct("importance", "feature")).alias("top_feature"),
        F.avg("importance").alias("mean_importance"), F.max("importance").alias("max_importance"), F.min("importance").alias("min_importance"),
    )


def importance_agg(log: DataFrame, how: str = "mean", k: int | None = None, kind: str | None = None) -> DataFrame:
    src = log.where(F.col("type") == kind) if kind else log
    if how == "median":
        g = quantiles(src, ["feature"], "score", {"importance": 0.5})
    elif how in ("mean", "max"):
        g = src.groupBy("feature").agg((F.avg if how == "mean" else F.max)("score").alias("importance"))
    else:
        raise ValueError(f"unknown aggregation {how!r}")
    return g.orderBy(F.col("importance").desc(), "feature").limit(k) if k else g


def importance_trend(log: DataFrame, feature: str) -> DataFrame:
    return log.where(F.col("feature") == feature).select("timestamp", "model_id", "score").orderBy("timestamp", "model_id")


def importance_stability(log: DataFrame) -> DataFrame:
    g = log.groupBy("feature").agg(
        F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.count("score").alias("count"),
        F.min("score").alias("min"), F.max("score").alias("max"),
    )
    return g.withColumn("cv", F.when(F.col("mean") != 0, F.col("std") / F.col("mean")))

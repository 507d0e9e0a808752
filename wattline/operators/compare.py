"""Model comparison and ranking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.operators import stattests as T
from wattline.operators.folds import time_folds
from wattline.operators.joins import pivot_models
from wattline.operators.metrics import metrics

HIGHER = ("r2",)
KEYS = ("ts", "area", "horizon")


def pair_rows(df: DataFrame, models: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, model_a, model_b, yhat_a, yhat_b, y) of every pair, from one gathering shuffle."""
    ms = sorted(models)
    wide = pivot_models(df, ms, keys, keep=["y"])
    pairs = F.array(*[
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), F.col(a).alias("yhat_a"), F.col(b).alias("yhat_b"))
        for i, a in enumerate(ms) for b in ms[i + 1:]
    ])
    return wide.select(*keys, "y", F.explode(pairs).alias("p")).select(*keys, "y", "p.*").where("yhat_a is not null and yhat_b is not null")


def compare_pairs(df: DataFrame, models: Sequence[str], alpha: float = 0.05, h: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """t, Wilcoxon (n >= 20) and Diebold-Mariano per pair; significant when the largest p < alpha."""
    keys = [*by, "model_a", "model_b"]
    r = pair_rows(df, models).withColumns({"a": F.abs(F.col("y") - F.col("yhat_a")), "b": F.abs(F.col("y") - F.col("yhat_b"))})
    t = T.paired_t(r, keys).select(*keys, "n", "mean_diff", "t", "effect_size", F.col("p_value").alias("t_p"))
    w = T.wilcoxon(r, keys).select(*keys, F.col("statistic").alias("wilcoxon"), F.when(F.col("n") >= 20, F.col("p_value")).alias("wilcoxon_p"))
    dm = T.diebold_mariano(r, keys, h=h, tie=["area", "horizon"]).select(*keys, "dm", F.col("p_value").alias("dm_p"))
    j = t.join(w, keys, "left").join(dm, keys)
    worst = F.greatest("t_p", F.coalesce("wilcoxon_p", F.lit(0.0)), "dm_p")
    return j.withColumns({
        "is_significant": worst < alpha,
        "better_model": F.when(F.col("mean_diff") < 0, F.col("model_a")).otherwise(F.col("model_b")),
    })


def _order(metric: str) -> list[Column]:
    c = F.col(metric)
    return [c.desc() if metric in HIGHER else c.asc(), F.col("model").asc()]


def rank_models(m: DataFrame, metric: str = "smape", by: Sequence[str] = ("area",)) -> DataFrame:
    return m.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*_order(metric))))


def rank_weighted(m: DataFrame, weights: Mapping[str, float], by: Sequence[str] = ("area",)) -> DataFrame:
    w = Window.partitionBy(*by)
    score, total = F.lit(0.0), 0.0
    for c, k in weights.items():
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        good = (F.col(c) - lo) if c in HIGHER else (hi - F.col(c))
        score, total = score + k * good / (hi - lo + 1e-10), total + k
    s = m.withColumn("score", score / total)
    return s.withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), "model")))


def rank_borda(m: DataFrame, metrics_: Sequence[str], by: Sequence[str] = ("area",)) -> DataFrame:
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    parts = [n - F.row_number().over(w.orderBy(*_order(c))) for c in metrics_]
    s = m.withColumn("score", reduce(lambda a, b: a + b, parts).cast("double"))
    return s.withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), "model")))


def pareto(m: DataFrame, metrics_: Sequence[str], by: Sequence[str] = ("area",)) -> DataFrame:
    """Models no other model of the group beats: at least as good everywhere, better once."""
    o = m.select(*[F.col(b).alias(f"__{b}") for b in by], *[F.col(c).alias(f"__{c}") for c in metrics_])
    good = lambda c, strict: (
        (F.col(f"__{c}") > F.col(c) if strict else F.col(f"__{c}") >= F.col(c)) if c in HIGHER
        else (F.col(f"__{c}") < F.col(c) if strict else F.col(f"__{c}") <= F.col(c)))
    every = reduce(lambda a, b: a & b, [good(c, False) for c in metrics_])
    some = reduce(lambda a, b: a | b, [good(c, True) for c in metrics_])
    same = reduce(lambda a, b: a & b, [F.col(b) == F.col(f"__{b}") for b in by])
    return m.join(o, same & every & some, "left_anti")


def rank_pareto(m: DataFrame, metrics_: Sequence[str], by: Sequence[str] = ("area",), tie: str = "smape") -> DataFrame:
    """Pareto-optimal models first, each part by ``tie``."""
    front = pareto(m, metrics_, by).select(*by, "model", F.lit(True).alias("is_pareto"))
    x = m.join(front, [*by, "model"], "left").withColumn("is_pareto", F.coalesce("is_pareto", F.lit(False)))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("is_pareto").desc(), *_order(tie))))


def recommendation(ranks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Best model, whether it is significantly better than every other, and a sentence."""
    best = ranks.where("rank = 1").select(F.col("model").alias("best_model"))
    j = best.join(pairs, (F.col("best_model") == F.col("model_a")) | (F.col("best_model") == F.col("model_b")), "left")
    g = j.groupBy("best_model").agg(F.coalesce(F.bool_and(F.col("is_significant") & (F.col("better_model") == F.col("best_model"))), F.lit(True)).alias("is_significantly_best"))
    text = F.when(F.col("is_significantly_best"), F.concat_ws(" ", F.lit("Use"), "best_model", F.lit("(significantly better than all others)"))) \
        .otherwise(F.concat_ws(" ", "best_model", F.lit("ranks first, but not significantly")))
    return g.withColumn("recommendation", text)


def cv_metrics(df: DataFrame, k: int = 5, gap: int = 0, by: Sequence[str] = ("area", "model"), t: str = "ts",
               series: Sequence[str] = ("area", "model", "horizon")) -> DataFrame:
    """Metric mean and std over the test blocks of time-ordered folds."""
    f = time_folds(df, k, gap, t, series).where("fold >= 1")
    m = metrics(f, [*by, "fold"])
    return m.groupBy(*by).agg(*[a for c in ("smape", "mae", "rmse") for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))], F.count(F.lit(1)).alias("folds"))


def metric_matrix(m: DataFrame, models: Sequence[str], metric: str = "smape", by: Sequence[str] = ("horizon",)) -> DataFrame:
    return m.groupBy(*by).agg(*[F.max(F.when(F.col("model") == x, F.col(metric))).alias(x) for x in models])


def compare_horizons(df: DataFrame, metric: str = "smape") -> DataFrame:
    return rank_models(metrics(df, ["horizon", "model"]), metric, by=["horizon"])


def evaluation_summary(parts: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Sections stacked as (section, key, measure, value): name -> (frame, key columns, measures)."""
    out = []
    for name, (d, keys, vals) in parts.items():
        key = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
        cells = F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in vals])
        out.append(d.select(F.lit(name).alias("section"), key.alias("key"), F.explode(cells).alias("c")).select("section", "key", "c.*"))
    return reduce(lambda a, b: a.unionByName(b), out)

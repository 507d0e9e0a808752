"""Choice of an ensemble: sets of models as rows, extended, bounded and pruned as tables.

A set of k models has the estimated error M * (0.9 + 0.1 * D), with M its mean MAPE and D its mean pairwise
dissimilarity (1 - |correlation|), and the value  w_acc / (error + 1) + w_div * D - w_cost * k / hi.
For a set that is still to be filled, the smallest possible M and the largest possible D bound the
value from above: for given M it is convex in D, so its largest value is at one end of D's range.
A set whose bound is below the best complete set can't lead to a better one and is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.ordered import stable
from wattline.operators.diversity import PAIR, corr_pairs, model_profile, model_scores

# Share of the error that remains at full and at no dissimilarity; correlation beyond which a model adds nothing.
BASE_SHARE, DISSIMILAR_SHARE, REDUNDANT = 0.9, 0.1, 0.95
WEIGHTS = (0.6, 0.3, 0.1)


def model_tables(df: DataFrame, models: Sequence[str], w: tuple[float, float, float] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(model, mape, score), and (model, other, dissimilarity) in both directions."""
    scores = stable(model_scores(model_profile(df, models), w).select("model", "mape", "score"))
    p = corr_pairs(df, models).select(*PAIR, (1 - F.abs("correlation")).alias("dissimilarity"))
    swap = p.select(F.col("model_b").alias("model"), F.col("model_a").alias("other"), "dissimilarity")
    return scores, stable(p.select(F.col("model_a").alias("model"), F.col("model_b").alias("other"), "dissimilarity").unionByName(swap))


def _error(m: Column, d: Column) -> Column:
    return m * (BASE_SHARE + DISSIMILAR_SHARE * F.least(d, F.lit(1.0)))


def best_set(scores: DataFrame, pairs: DataFrame, lo: int = 2, hi: int = 3, w: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """(members, size, mape, diversity, value) of the best set of lo to hi models; of equal sets the smaller, then the first by name."""
    spark = scores.sparkSession
    names = [r["model"] for r in scores.select("model").orderBy("model").collect()]  # one row per model
    m, at = len(names), {n: i for i, n in enumerate(names)}
    mape, dis = np.zeros(m), np.zeros((m, m))
    for r in scores.collect():
        mape[at[r["model"]]] = r["mape"]
    for r in pairs.collect():
        dis[at[r["model"]], at[r["other"]]] = r["dissimilarity"]
    lo, hi = min(lo, m), min(hi, m)
    tail = lambda i, r: np.sort(mape[i:])[:r].sum()
    least = F.lit([[float(tail(i, r)) for r in range(hi + 1)] for i in range(m + 1)])  # r smallest errors from model i on
    reach = np.cumsum(np.pad(np.sort(dis, axis=1)[:, ::-1], ((0, 0), (1, 0))), axis=1)[:, :hi]  # a model's r largest dissimilarities
    errors, table, far = F.lit(mape.tolist()), F.lit(dis.tolist()), F.lit(reach.tolist())
    span, k = float(hi), F.col("k")

    def value(mean: Column, d: Column) -> Column:
        return w[0] / (_error(mean, d) + 1) + w[1] * d - w[2] * k / span

    pairs_of = k * (k - 1) / 2
    ratio = lambda x: F.when(k > 1, x / pairs_of).otherwise(F.lit(0.0))
    left = k - F.size("members")
    to_members = lambda j: F.aggregate("members", F.lit(0.0), lambda acc, i: acc + F.get(F.get(table, i), j))
    gains = F.transform(F.sequence(F.col("last") + 1, F.lit(m - 1)), lambda j: to_members(j) + F.get(F.get(far, j), left - 1) / 2)
    most = F.aggregate(F.slice(F.reverse(F.array_sort(gains)), F.lit(1), left), F.lit(0.0), lambda acc, x: acc + x)
    mean = (F.col("mape") + F.get(F.get(least, F.col("last") + 1), left)) / k
    bound = F.greatest(value(mean, F.lit(0.0)), value(mean, ratio(F.col("pairs") + most)))

    sets = spark.createDataFrame([(k, [], -1, 0.0, 0.0) for k in range(max(lo, 1), hi + 1)], "k int, members array<int>, last int, mape double, pairs double")
    best, full = _start(mape, dis, max(lo, 1), hi, w), None
    for size in range(1, hi + 1):
        grown = sets.select("k", "members", "mape", "pairs", F.explode(F.sequence(F.col("last") + 1, m - k + size - 1)).alias("j"))
        sets = stable(grown.select(
            "k", F.concat("members", F.array("j")).alias("members"), F.col("j").alias("last"), (F.col("mape") + F.get(errors, F.col("j"))).alias("mape"),
            (F.col("pairs") + to_members(F.col("j"))).alias("pairs")).where((k == size) | (bound >= best - 1e-12)))
        done = sets.where(k == size).select("k", "members", (F.col("mape") / k).alias("mean"), ratio(F.col("pairs")).alias("d"))
        done = done.select("*", value(F.col("mean"), F.col("d")).alias("value"))
        top = stable(done.orderBy(F.col("value").desc(), "members").limit(1))
        row = top.head()
        best = max(best, row["value"]) if row else best
        full = top if full is None else full.unionByName(top)
        sets = sets.where(k > size)
    name = F.transform("members", lambda i: F.get(F.lit(names), i))
    return full.orderBy(F.col("value").desc(), "k", "members").limit(1).select(
        name.alias("members"), F.col("k").alias("size"), _error(F.col("mean"), F.col("d")).alias("mape"), F.col("d").alias("diversity"), "value")


def _start(mape: np.ndarray, dis: np.ndarray, lo: int, hi: int, w: tuple[float, float, float]) -> float:
    """Value of a good set to prune against: the most accurate models, by number."""
    order = np.argsort(mape, kind="stable")
    out = -np.inf
    for k in range(lo, hi + 1):
        own = order[:k]
        d = dis[np.ix_(own, own)].sum() / (k * (k - 1)) if k > 1 else 0.0
        out = max(out, w[0] / (mape[own].mean() * (BASE_SHARE + DISSIMILAR_SHARE * min(d, 1.0)) + 1) + w[1] * d - w[2] * k / hi)
    return float(out)


def greedy_set(scores: DataFrame, pairs: DataFrame, lo: int = 2, hi: int = 3, gain: float = 0.001) -> DataFrame:
    """(members, size, mape, diversity): in order of score, the next model that is not redundant and lowers the error enough.

    A model that fails against a set fails against it for good, so each round asks the table of models for the
    first one after the last choice that passes; at most ``hi`` rounds.
    """
    ranked = stable(scores.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("score").desc(), "model"))))  # one row per model
    chosen, last = [ranked.where("rank = 1").head()], 1
    while True:
        held = [r["model"] for r in chosen]
        k, total = len(held), sum(r["mape"] for r in chosen)
        inside = pairs.where(F.col("model").isin(held) & F.col("other").isin(held)).agg(F.coalesce(F.sum("dissimilarity"), F.lit(0.0))).head()[0] / 2
        spread = inside / (k * (k - 1) / 2) if k > 1 else 0.0
        now = total / k * (BASE_SHARE + DISSIMILAR_SHARE * min(spread, 1.0))
        if k >= hi:
            break
        near = pairs.where(F.col("other").isin(held)).groupBy("model").agg(F.sum("dissimilarity").alias("to_held"))
        after = _error((F.col("mape") + total) / (k + 1), (F.col("to_held") + inside) / (k * (k + 1) / 2))
        usable = (1 - F.col("to_held") / k <= REDUNDANT) & ((now - after) / now > gain)
        free = ranked.join(near, "model").where(~F.col("model").isin(held))
        pick = free.where((F.col("rank") > last) & usable).orderBy("rank").head()
        if pick is None and k < lo:  # the smallest size is filled in order of score
            pick, last = free.orderBy("rank").head(), scores.count()
        if pick is None:
            break
        chosen.append(pick)
        last = max(last, pick["rank"])
    return scores.sparkSession.createDataFrame([(held, k, now, spread)], "members array<string>, size int, mape double, diversity double")


def select_ensemble(df: DataFrame, models: Sequence[str], lo: int = 2, hi: int = 3, method: str = "pareto", w: tuple[float, float, float] = WEIGHTS, gain: float = 0.001) -> DataFrame:
    """(model, ensemble_mape, ensemble_diversity) of the models chosen: ``pareto`` over all sets, or ``greedy``."""
    scores, pairs = model_tables(df, models, w)
    found = best_set(scores, pairs, lo, hi, w) if method == "pareto" else greedy_set(scores, pairs, lo, hi, gain)
    return found.select(F.explode("members").alias("model"), F.col("mape").alias("ensemble_mape"), F.col("diversity").alias("ensemble_diversity"))

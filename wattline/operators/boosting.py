"""Boosted regression trees for every group at once, by histograms.

A model is fitted for each group (an area) and each run (a fold, a grid point, the final fit), and all of
them grow together: one level of one tree is one aggregate over (group, run, node, feature, bin), whatever
the number of groups. Values are binned once, at quantiles of their group; rows hold a byte-sized
bin per feature, the target and the prediction so far. Sums of a bin are added up in the tasks before
the shuffle, so a group with a third of the rows is no hot key, and no task or driver holds a group.
Where all nodes of one level fit MAX_NODES, rows are dealt in blocks and a level is one small job
(``treeblocks.py``); beyond that, levels are tables and joins. Both give the same trees.

Squared loss: the residual's sum G and count n of a node give the gain GL^2/(nL+l2) + GR^2/(nR+l2)
- G^2/(n+l2) of a split and the value rate * G/(n+l2) of a leaf. Ties go to the first feature and the
lowest bin. A missing value has a bin of its own below all others.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.ordered import stable
from wattline.operators import treeblocks

DEFAULTS = {"rounds": 20, "depth": 5, "rate": 0.1, "l2": 1.0, "min_rows": 20, "train_before": None}
MIN_GAIN = treeblocks.MIN_GAIN
MAX_NODES = 1 << 17  # groups x runs x nodes of a tree that a broadcast may hold: 3 MB a tree


@dataclass
class Boosted:
    by: list[str]
    features: list[str]
    cuts: DataFrame  # by, cuts: array of arrays of thresholds, one for each feature
    base: DataFrame  # by, run, base: the mean of the target
    trees: DataFrame  # by, run, tree, node, feature, bin, gain, n, value, left_value, right_value
    fitted: DataFrame  # by, run, row, train, target, yhat


def quantile_cuts(df: DataFrame, features: Sequence[str], by: Sequence[str], bins: int) -> DataFrame:
    """Thresholds of every feature in every group, at most ``bins`` - 1 of them, distinct and rising."""
    probs = [i / bins for i in range(1, bins)]
    each = [F.array_sort(F.array_distinct(F.percentile_approx(F.col(f).cast("double"), probs, 10_000))) for f in features]
    none = F.array().cast("array<double>")
    return df.groupBy(*by).agg(F.array(*[F.coalesce(e, none) for e in each]).alias("cuts"))


def binned(df: DataFrame, features: Sequence[str], by: Sequence[str], cuts: DataFrame) -> DataFrame:
    """Adds ``bins``: 0 for a missing value, else 1 + the number of thresholds below the value."""
    def bin_of(i: int, f: str) -> Column:
        v = F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
        return F.when(v.isNull(), 0).otherwise(1 + F.size(F.filter(F.col("cuts")[i], lambda c: c < v))).cast("tinyint")

    return df.join(cuts, list(by)).withColumn("bins", F.array(*[bin_of(i, f) for i, f in enumerate(features)])).drop("cuts")


def _param(runs: Mapping[str, Mapping], name: str, kind: str) -> Column:
    pairs = [x for r, p in runs.items() for x in (F.lit(r), F.lit(p[name]).cast(kind))]
    return F.element_at(F.create_map(*pairs), F.col("run"))


def _tree_arrays(levels: Sequence[DataFrame], keys: Sequence[str], depth: int) -> DataFrame:
    """One row per key: the nodes of a tree in heap order, null where nothing splits, and the root's value."""
    rows = reduce(DataFrame.unionByName, levels)
    split = F.when(F.col("feature").isNotNull(), F.struct("feature", "bin", "left_value", "right_value"))
    made = rows.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("node", split.alias("s")))).alias("__m"), F.max(F.when(F.col("node") == 0, F.col("value"))).alias("__v"))
    return made.select(*keys, "__v", F.transform(F.sequence(F.lit(0), F.lit(2**depth - 2)), lambda i: F.element_at("__m", i)).alias("__t"))


def _step(state: Column, heap: Column) -> Column:
    """One level down from ``state(node, v)``; it stays where nothing splits."""
    s = F.get(heap, state["node"])
    right = F.get("bins", s["feature"]) > s["bin"]  # null at a leaf
    v = F.coalesce(F.when(right, s["right_value"]).when(~right, s["left_value"]), state["v"])
    return F.struct(F.coalesce(2 * state["node"] + 1 + right.cast("int"), state["node"]).alias("node"), v.alias("v"))


def _walk(heap: Column, value: Column, depth: int) -> Column:
    """(node, v) reached from the root; a fold over the levels, so the plan doesn't grow with depth."""
    start = F.struct(F.lit(0).alias("node"), value.alias("v"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), start, lambda state, _: _step(state, heap))


def _descend(df: DataFrame, depth: int) -> DataFrame:
    """Adds ``__node`` (heap position reached) and ``__v`` (its value) from ``__t``, ``__v`` and ``bins``."""
    out = df.withColumn("__at", _walk(F.col("__t"), F.col("__v"), depth))
    return out.withColumns({"__node": F.col("__at.node"), "__v": F.col("__at.v")}).drop("__at", "__t")


def _grow(state: DataFrame, tree: DataFrame | None, level: int, keys: Sequence[str], runs: Mapping[str, Mapping]) -> DataFrame:
    """The nodes of one level of all trees, with the best split of each."""
    rows = state.where("train")
    rows = rows.withColumn("__node", F.lit(0)) if tree is None else _descend(rows.join(tree, list(keys)), level)
    rows = rows.where((F.col("__node") >= 2**level - 1) & (_param(runs, "depth", "int") > level))
    cells = rows.select(*keys, F.col("__node").alias("node"), (F.col("target") - F.col("pred")).alias("r"), F.posexplode("bins").alias("feature", "bin"))
    hist = cells.groupBy(*keys, "node", "feature", "bin").agg(F.sum("r").alias("g"), F.count(F.lit(1)).alias("n"))
    hist = hist.repartition(*keys, "node")  # windows and choice below need no other exchange
    one = Window.partitionBy(*keys, "node", "feature")
    left = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select("*", F.sum("g").over(left).alias("gl"), F.sum("n").over(left).alias("nl"), F.sum("g").over(one).alias("gt"), F.sum("n").over(one).alias("nt"))
    l2, rate, least = (_param(runs, n, "double") for n in ("l2", "rate", "min_rows"))
    part = lambda g, n: g * g / (n + l2)
    gl, nl, gt, nt = (F.col(c) for c in ("gl", "nl", "gt", "nt"))
    gain = part(gl, nl) + part(gt - gl, nt - nl) - part(gt, nt)
    usable = (nl >= least) & (nt - nl >= least) & (gain > MIN_GAIN)
    best = hist.groupBy(*keys, "node").agg(
        F.max(F.when(usable, F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "gl", "nl", "gt", "nt"))).alias("s"),
        F.max_by("gt", -F.col("feature")).alias("g"), F.max("nt").alias("n"))
    s = lambda c: F.col(f"s.{c}")
    return best.select(
        *keys, "node", (-s("f")).alias("feature"), (-s("b")).cast("int").alias("bin"), s("gain").alias("gain"), "n", (rate * F.col("g") / (F.col("n") + l2)).alias("value"),
        (rate * s("gl") / (s("nl") + l2)).alias("left_value"), (rate * (s("gt") - s("gl")) / (s("nt") - s("nl") + l2)).alias("right_value"))


def boost(
    df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ("area",), row: Sequence[str] = ("ts",),
    runs: Mapping[str, Mapping] | None = None, fold: str | None = None, bins: int = 32,
) -> Boosted:
    """Fits every run in every group. A run's settings replace DEFAULTS; its training rows are those
    with ``fold`` < ``train_before`` (all, if that is None), and the next block is predicted along the way."""
    if not 2 <= bins <= 126:
        raise ValueError("bins must be 2 to 126")
    by, features = list(by), list(features)
    runs = {name: {**DEFAULTS, **given} for name, given in (runs or {"all": {}}).items()}
    row = list(row)
    rows = df.where(F.col(target).isNotNull())
    cuts = stable(quantile_cuts(rows, features, by, bins))
    rows = binned(rows, features, by, cuts).select(*by, F.struct(*row).alias("row"), F.col(target).cast("double").alias("target"), "bins", F.col(fold).cast("int").alias("__fold") if fold else F.lit(None).cast("int").alias("__fold"))
    if not fold:
        runs = {name: {**p, "train_before": None} for name, p in runs.items()}
    groups = cuts.count()
    if 0 < groups * len(runs) * 2 ** max(p["depth"] for p in runs.values()) <= MAX_NODES:
        rows = stable(rows)
        base, grown, fitted = treeblocks.grow(rows, treeblocks.grouped(rows, by, runs), groups, by, runs, len(features), bins)
        return Boosted(by, features, cuts, base, grown, fitted)
    return _boost_joined(rows, cuts, by, features, runs, fold)


def _boost_joined(rows: DataFrame, cuts: DataFrame, by: list[str], features: list[str], runs: Mapping[str, Mapping], fold: str | None) -> Boosted:
    """Any number of groups: trees and predictions are tables, every level is an aggregate and a join."""
    keys = [*by, "run"]
    rows = rows.withColumn("run", F.explode(F.array(*[F.lit(r) for r in runs])))
    if fold:
        before = _param(runs, "train_before", "int")
        rows = rows.where(F.coalesce(F.col("__fold") <= before, F.lit(True))).withColumn("train", F.coalesce(F.col("__fold") < before, F.lit(True))).drop("__fold")
    else:
        rows = rows.withColumn("train", F.lit(True)).drop("__fold")
    rows = stable(rows)
    base = stable(rows.where("train").groupBy(*keys).agg(F.avg("target").alias("base")))
    state, trees = rows.join(base, keys).withColumnRenamed("base", "pred"), []
    state = stable(state)
    for t in range(max(r["rounds"] for r in runs.values())):
        live = {n: r for n, r in runs.items() if r["rounds"] > t}
        some = state if len(live) == len(runs) else state.where(F.col("run").isin(list(live)))
        levels: list[DataFrame] = []
        for level in range(max(r["depth"] for r in live.values())):
            tree = _tree_arrays(levels, keys, level) if levels else None
            levels.append(stable(_grow(some, tree, level, keys, live)))
        done = _tree_arrays(levels, keys, len(levels))
        moved = _descend(state.join(done, keys, "left"), len(levels))
        state = stable(moved.select(*keys, "row", "target", "bins", "train", (F.col("pred") + F.coalesce("__v", F.lit(0.0))).alias("pred")))
        trees += [x.withColumn("tree", F.lit(t)) for x in levels]
    grown = reduce(DataFrame.unionByName, trees)
    fitted = state.select(*keys, "row.*", "train", "target", F.col("pred").alias("yhat"))
    return Boosted(by, features, cuts, base, grown, fitted)


def predict(model: Boosted, df: DataFrame, run: str = "all") -> DataFrame:
    """Adds ``yhat`` to rows of known groups; a group's trees travel to its rows as one array."""
    rows = binned(df, model.features, model.by, model.cuts)
    splits = model.trees.where((F.col("run") == run) & F.col("feature").isNotNull())
    depth = int((splits.agg(F.max("node")).head()[0] or 0) + 1).bit_length()
    nodes = F.struct("feature", "bin", "left_value", "right_value")
    tree = model.trees.where(F.col("run") == run).groupBy(*model.by, "tree").agg(
        F.map_from_entries(F.collect_list(F.struct("node", F.when(F.col("feature").isNotNull(), nodes).alias("s")))).alias("m"), F.max(F.when(F.col("node") == 0, F.col("value"))).alias("v"))
    heap = F.transform(F.sequence(F.lit(0), F.lit(2**depth - 2)), lambda i: F.element_at("m", i))
    forest = tree.groupBy(*model.by).agg(F.collect_list(F.struct(heap.alias("t"), "v")).alias("__forest"))

    value = lambda one: _walk(one["t"], one["v"], depth)["v"]
    start = model.base.where(F.col("run") == run).drop("run")
    return rows.join(forest, model.by).join(start, model.by).withColumn(
        "yhat", F.col("base") + F.aggregate("__forest", F.lit(0.0), lambda acc, one: acc + F.coalesce(value(one), F.lit(0.0)))).drop("bins", "__forest", "base")


def importance(model: Boosted, run: str = "all") -> DataFrame:
    """(by, feature, importance): share of the gain of all splits of a group."""
    gain = model.trees.where(F.col("run") == run).where("feature is not null").groupBy(*model.by, "feature").agg(F.sum("gain").alias("g"))
    names = F.array(*[F.lit(f) for f in model.features])
    every = model.base.where(F.col("run") == run).select(*model.by, F.posexplode(names).alias("feature", "name"))
    out = every.join(gain, [*model.by, "feature"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    total = F.sum("g").over(Window.partitionBy(*model.by))  # a row for each feature
    return out.select(*model.by, F.col("name").alias("feature"), F.when(total > 0, F.col("g") / total).otherwise(0.0).alias("importance"))


def fold_runs(folds: int, **settings) -> dict[str, dict]:
    """A run for every time fold, trained on the blocks before it, and ``all``."""
    return {**{f"fold{k}": {**settings, "train_before": k} for k in range(1, folds + 1)}, "all": settings}


def fold_errors(model: Boosted) -> DataFrame:
    """(by, run, n, mae) of each run on the block that follows its training rows."""
    error = F.abs(F.col("target") - F.col("yhat"))
    return model.fitted.where("not train").groupBy(*model.by, "run").agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mae"))

"""Least squares on a tree for many time stamps at once, with missing values.

The nodes of one key (a time stamp) are one vector. A pass up combines what a node's own forecast and its
children say, by precision; a pass down hands the surplus of a parent to its children in
proportion to variance. Both are done level by level on a block of keys x nodes, so any pattern of
missing nodes costs the same: a missing forecast has unlimited variance. A node that neither its forecast nor
its children determine gets what its parent and siblings leave; where that leaves a choice it is NaN.

Memory is one Arrow batch (limited by bytes) of vectors; the tree itself is a table of nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = 1_000_000  # nodes of a vector: 20 MB a key


@dataclass
class Tree:
    names: list[str]
    parent: np.ndarray  # position of the parent, -1 at a root
    weight: np.ndarray  # of the edge to the parent
    levels: list[np.ndarray]  # positions by depth; those of one parent stand together

    @property
    def at(self) -> dict[str, int]:
        return {n: i for i, n in enumerate(self.names)}


def make_tree(levels: DataFrame, edges: DataFrame, limit: int = NODES) -> Tree | None:
    """From (node, level) and (parent, child, weight); None beyond ``limit`` nodes."""
    rows = levels.select("node", "level").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    up = {r["child"]: (r["parent"], r["weight"]) for r in edges.select("parent", "child", "weight").collect()}
    depth = {r["node"]: r["level"] for r in rows}
    names = sorted(depth, key=lambda n: (depth[n], up.get(n, ("",))[0] or "", n))
    at = {n: i for i, n in enumerate(names)}
    parent = np.array([at[up[n][0]] if n in up else -1 for n in names], dtype=np.int64)
    weight = np.array([float(up[n][1]) if n in up else 0.0 for n in names])
    level = np.array([depth[n] for n in names], dtype=np.int64)
    own = [np.flatnonzero(level == d) for d in range(int(level.max(initial=-1)) + 1)]
    return Tree(names, parent, weight, [x[np.argsort(parent[x], kind="stable")] for x in own])


def solve(x: np.ndarray, var: np.ndarray, tree: Tree) -> np.ndarray:
    """Reconciled block of keys x nodes; ``x`` has NaN where a forecast is missing, ``var`` has the same shape or one row."""
    var = np.broadcast_to(var, x.shape)
    k, n = x.shape
    m, v = np.full((k, n), np.nan), np.full((k, n), np.nan)
    mean, spread, unknown, has = np.zeros((k, n)), np.zeros((k, n)), np.zeros((k, n)), np.zeros(n, dtype=bool)

    with np.errstate(divide="ignore", invalid="ignore"):
        for own in reversed(tree.levels):
            seen, said = ~np.isnan(x[:, own]), has[own] & (unknown[:, own] == 0)
            kv, km, ov, ox = spread[:, own], mean[:, own], var[:, own], x[:, own]
            exact, a, b = said & (kv == 0), 1 / ov, 1 / kv
            v[:, own] = np.select([exact, seen & said, seen, said], [0.0, 1 / (a + b), ov, kv], np.nan)
            m[:, own] = np.select([exact, seen & said, seen, said], [km, (a * ox + b * km) / (a + b), ox, km], np.nan)
            below = own[tree.parent[own] >= 0]
            if len(below):
                p, w = tree.parent[below], tree.weight[below]
                first = np.flatnonzero(np.diff(p, prepend=-2))
                heads = p[first]
                open_ = np.isnan(v[:, below])
                mean[:, heads] += np.add.reduceat(np.where(open_, 0.0, w * m[:, below]), first, axis=1)
                spread[:, heads] += np.add.reduceat(np.where(open_, 0.0, w * w * v[:, below]), first, axis=1)
                unknown[:, heads] += np.add.reduceat(open_ & (w != 0), first, axis=1)
                has[heads] = True
        out = m.copy()
        for own in tree.levels[1:]:
            own = own[tree.parent[own] >= 0]
            p, w = tree.parent[own], tree.weight[own]
            gap = out[:, p] - mean[:, p]
            open_ = np.isnan(v[:, own])
            share = np.where((unknown[:, p] == 0) & (spread[:, p] > 0), w * v[:, own] / spread[:, p] * gap, 0.0)
            alone = open_ & (unknown[:, p] == 1) & (w != 0)
            out[:, own] = np.select([~open_, alone], [m[:, own] + share, gap / w], np.nan)
    return out


def solve_factors(x: np.ndarray, var: np.ndarray, loadings: np.ndarray, tree: Tree) -> np.ndarray:
    """As ``solve`` for the covariance diag(var) + L L'.

    With f the common factors, x = S b + L f + e: for given f the tree solves x - L f, and the best f
    solves a k x k system (Woodbury). Keys with the same nodes missing share the solved loadings.
    """
    out = solve(x, var, tree)
    k = loadings.shape[1]
    masks, which = np.unique(np.isnan(x), axis=0, return_inverse=True)
    for i, missing in enumerate(masks):
        rows = np.flatnonzero(which.ravel() == i)
        seen = ~missing
        if not k or not seen.any():
            continue
        own = solve(np.where(missing, np.nan, loadings.T), var, tree)  # T L, one row per factor
        rest = (loadings.T - own)[:, seen] / var[seen]  # D^-1 (L - T L), transposed
        small = np.eye(k) + rest @ loadings[seen]
        gap = (x[np.ix_(rows, seen)] - out[np.ix_(rows, seen)]) / var[seen]
        f = np.linalg.solve(small, (gap @ loadings[seen]).T).T
        out[rows] -= f @ own
    return out


def vectors(fc: DataFrame, tree: Tree, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per key with the entries of its nodes; nodes outside the tree are left out."""
    place = fc.sparkSession.createDataFrame(list(enumerate(tree.names)), "__i int, node string")
    entry = F.struct("__i", *[F.col(c).cast("double").alias(c) for c in cols])
    return fc.join(place, "node", "left").groupBy(*keys).agg(F.collect_list(F.when(F.col("__i").isNotNull(), entry)).alias("__x"))


def blocks(lists: pa.ListArray, n: int, cols: Sequence[str]) -> list[np.ndarray]:
    """Keys x nodes for each column, NaN where there is no entry."""
    flat = lists.flatten()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    place = flat.field("__i").to_numpy()
    out = []
    for c in cols:
        block = np.full((len(lists), n), np.nan)
        block[row, place] = flat.field(c).to_numpy(zero_copy_only=False)
        out.append(block)
    return out


def reconcile(fc: DataFrame, tree: Tree, keys: Sequence[str], var: np.ndarray | None = None, loadings: np.ndarray | None = None) -> DataFrame:
    """keys, node, yhat for every node of every key of ``fc``. Without ``var`` the rows carry a column ``var``."""
    keys, n = list(keys), len(tree.names)
    cols = ["yhat"] if var is not None else ["yhat", "var"]
    vec = vectors(fc, tree, keys, cols)
    schema = ", ".join(f"`{k}` {t}" for k, t in vec.dtypes if k != "__x") + ", node string, yhat double"

    def run(batches):
        names = pa.array(tree.names)
        for b in batches:
            step = max(1, 4_000_000 // max(n, 1))
            for a in range(0, b.num_rows, step):
                s = b.slice(a, step)
                found = blocks(s.column("__x"), n, cols)
                v = var if var is not None else np.where(np.isnan(found[1]), 1.0, found[1])
                y = solve(found[0], v, tree) if loadings is None else solve_factors(found[0], v, loadings, tree)
                rows = pa.array(np.repeat(np.arange(s.num_rows), n))
                yield pa.RecordBatch.from_arrays(
                    [*(s.column(k).take(rows) for k in keys), names.take(pa.array(np.tile(np.arange(n), s.num_rows))), pa.array(y.ravel(), from_pandas=True)],
                    names=[*keys, "node", "yhat"])

    return vec.mapInArrow(run, schema)


@dataclass
class Factors:
    mean: np.ndarray
    loadings: np.ndarray  # nodes x factors
    var: np.ndarray  # specific variance; infinite where a node has no residual
    rounds: int


def fit_factors(res: DataFrame, tree: Tree, k: int = 1, v: str = "e", key: str = "ts", tol: float = 1e-4, rounds: int = 500, floor: float = 1e-6) -> Factors:
    """Factor model of the residuals by EM, from all time stamps, whatever is missing in each.

    A round is one pass: tasks estimate the factors of their time stamps from the nodes seen and add
    up k x k numbers per node. Nothing of size nodes x nodes is made anywhere.
    """
    from wattline.functions.ordered import stable

    n = len(tree.names)
    vec = stable(vectors(res.where(F.col(v).isNotNull()), tree, [key], [v]).select("__x"))
    place = res.sparkSession.createDataFrame(list(enumerate(tree.names)), "i int, node string")
    first = res.join(place, "node").groupBy("i").agg(F.avg(v).alias("m"), F.var_pop(v).alias("s"), F.count(v).alias("n")).collect()  # a row per node
    mean, var, count = np.zeros(n), np.full(n, np.inf), np.zeros(n)
    for r in first:
        if r["n"]:
            mean[r["i"]], var[r["i"]], count[r["i"]] = r["m"], max(r["s"], floor), r["n"]
    total = np.where(np.isfinite(var), var, 0.0)
    start = np.random.default_rng(0)
    loadings = np.sqrt(total / 2)[:, None] * np.where(np.arange(k) == 0, 1.0, start.standard_normal((n, k)))
    var = np.where(count > 0, np.maximum(total / 2, floor), np.inf)

    def expect(mean, var, loadings):
        pair = (loadings[:, :, None] * loadings[:, None, :]).reshape(n, k * k)

        def run(batches):
            acc = np.zeros((n, k * k + k + 1))
            for b in batches:
                step = max(1, 2_000_000 // max(n, 1))
                for a in range(0, b.num_rows, step):
                    x = blocks(b.column("__x").slice(a, step), n, [v])[0] - mean
                    seen = ~np.isnan(x)
                    w = np.where(seen, 1 / var, 0.0)
                    x = np.where(seen, x, 0.0)
                    spread = np.linalg.inv(np.eye(k) + (w @ pair).reshape(-1, k, k))
                    f = np.einsum("tij,tj->ti", spread, (w * x) @ loadings)
                    both = (spread + f[:, :, None] * f[:, None, :]).reshape(-1, k * k)
                    acc += np.hstack([seen.T @ both, x.T @ f, (x * x).sum(axis=0)[:, None]])
            i, j = np.indices(acc.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(acc.ravel())], names=["i", "j", "s"])

        acc = np.zeros((n, k * k + k + 1))
        for r in vec.mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # nodes x factors squared
            acc[r["i"], r["j"]] = r["s"]
        return acc[:, :k * k].reshape(n, k, k), acc[:, k * k:-1], acc[:, -1]

    for done in range(1, rounds + 1):
        ff, xf, xx = expect(mean, var, loadings)
        new = np.zeros_like(loadings)
        own = count > 0
        new[own] = np.linalg.solve(ff[own], xf[own][:, :, None])[:, :, 0]
        left = np.full(n, np.inf)
        left[own] = np.maximum((xx[own] - (new[own] * xf[own]).sum(axis=1)) / count[own], floor)
        moved = np.abs((new**2).sum(axis=1) - (loadings**2).sum(axis=1))[own] / np.maximum(total[own], floor)
        loadings, var = new, left
        if moved.max(initial=0.0) < tol:
            return Factors(mean, loadings, var, done)
    raise ArithmeticError(f"the factor model still moves after {rounds} rounds")

"""Forecast reconciliation.

OLS and WLS (diagonal weights) on a tree are solved exactly by a pass up and a pass
down over the vector of a time stamp (``treesolve.py``), whatever nodes are missing in it. No
matrix is formed, so the number of nodes is not limited. So is MinT with a covariance of common factors
and specific variances. The other full-covariance methods need an n x n matrix and use it on
the workers for batches of time stamps; beyond DENSE_LIMIT nodes they are refused.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions import tails
from wattline.functions.moments import correlation
from wattline.functions.ordered import bounded, positions, stable
from wattline.operators import stattests as T
from wattline.operators import treesolve as X
from wattline.operators.folds import time_folds
from wattline.operators.metrics import metrics

DENSE_LIMIT = 4000  # nodes of a dense covariance


# --- aggregation -----------------------------------------------------------------
def bottom_up(leaf: DataFrame, S: DataFrame, keys: Sequence[str] = ("ts",), y: str = "yhat") -> DataFrame:
    up = S.select(F.col("node").alias("__up"), "leaf", "w")
    j = leaf.join(up, F.col("node") == F.col("leaf"))
    return j.groupBy(*keys, F.col("__up").alias("node")).agg(F.sum(F.col("w") * F.col(y)).alias(y))


def child_sums(fc: DataFrame, edges: DataFrame, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Parents with the weighted sum of their children."""
    s = fc.join(edges, F.col("node") == F.col("child")).groupBy(*keys, F.col("parent").alias("node")).agg(F.sum(F.col("weight") * F.col("yhat")).alias("expected"))
    return fc.join(s, [*keys, "node"])


def coherence(fc: DataFrame, S: DataFrame, keys: Sequence[str] = ("ts",)) -> DataFrame:
    leaves = S.select(F.col("leaf").alias("node")).distinct()
    up = bottom_up(fc.join(leaves, "node", "left_semi"), S, keys).withColumnRenamed("yhat", "sum")
    d = F.col("yhat") - F.col("sum")
    return fc.join(up, [*keys, "node"]).groupBy(*[k for k in keys if k != "ts"]).agg(
        (F.sqrt(F.sum(d * d)) / F.sqrt(F.sum(F.col("yhat") * F.col("yhat")))).alias("coherence_error"), F.max(F.abs(d)).alias("max_violation"))


def floor_zero(fc: DataFrame) -> DataFrame:
    return fc.withColumn("yhat", F.greatest("yhat", F.lit(0.0)))


def _levels(edges: DataFrame) -> DataFrame:
    from wattline.operators.hierarchy import closure, levels

    return levels(closure(edges))


def reconcile_wls(fc: DataFrame, edges: DataFrame, weights: DataFrame | None = None, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """``weights(node, var)`` (or with the keys too); smaller variance counts more. A missing
    forecast is a forecast of unlimited variance; nodes that the rest doesn't determine are null.

    A key's nodes are one vector, solved in one pass up and down the tree. Beyond
    ``treesolve.NODES`` nodes a key goes level by level, as joins.
    """
    keys = list(keys)
    edges = stable(edges.select("parent", "child", "weight"))
    lv = stable(_levels(edges))
    fc = fc.select(*keys, "node", "yhat")
    per_key = weights is not None and any(k in weights.columns for k in keys)
    tree = X.make_tree(lv, edges)
    if tree is None:
        if weights is None:
            weights = lv.select("node", F.lit(1.0).alias("var"))
        return _by_level(fc, edges, lv, weights, keys)
    if per_key:
        on = [c for c in [*keys, "node"] if c in weights.columns]
        return X.reconcile(fc.join(weights.select(*on, "var"), on, "left"), tree, keys)
    var = np.ones(len(tree.names))
    if weights is not None:
        at = tree.at
        for r in weights.select("node", "var").where("var is not null").collect():  # a row per node
            if r["node"] in at:
                var[at[r["node"]]] = r["var"]
    return X.reconcile(fc, tree, keys, var)


def _by_level(fc: DataFrame, edges: DataFrame, lv: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every node of every key. A node of which neither its forecast nor its children say
    anything is open (``v`` is null); the only open child of a parent gets what its siblings leave,
    more than one stay null."""
    depth = lv.agg(F.max("level")).head()[0]
    on = [c for c in [*keys, "node"] if c in weights.columns]
    every = fc.select(*keys).distinct().crossJoin(lv)
    x = every.join(fc.select(*keys, "node", "yhat"), [*keys, "node"], "left").join(weights.select(*on, "var"), on, "left")
    x = stable(x.withColumn("var", F.coalesce("var", F.lit(1.0))))
    seen = F.col("yhat").isNotNull()
    ups: list[DataFrame] = []
    below = None
    for level in range(depth, -1, -1):
        cur = x.where(F.col("level") == level).drop("level")
        if below is None:
            cur = cur.withColumns({"kids_mean": F.lit(None).cast("double"), "kids_var": F.lit(None).cast("double"), "kids_open": F.lit(0).cast("long")})
        else:
            s = below.join(edges, F.col("node") == F.col("child")).groupBy(*keys, F.col("parent").alias("node")).agg(
                F.sum(F.col("weight") * F.col("m")).alias("kids_mean"), F.sum(F.col("weight") * F.col("weight") * F.col("v")).alias("kids_var"),
                F.count_if(F.col("v").isNull() & (F.col("weight") != 0)).alias("kids_open"))
            cur = cur.join(s, [*keys, "node"], "left").withColumn("kids_open", F.coalesce("kids_open", F.lit(0)))
        said = F.col("kids_var").isNotNull() & (F.col("kids_open") == 0)
        exact = said & (F.col("kids_var") == 0)
        own, kids = 1 / F.col("var"), 1 / F.col("kids_var")
        v = F.when(exact, 0.0).when(seen & said, 1 / (own + kids)).when(seen, F.col("var")).when(said, F.col("kids_var"))
        m = F.when(exact, F.col("kids_mean")).when(seen & said, (own * F.col("yhat") + kids * F.col("kids_mean")) / (own + kids)).when(seen, F.col("yhat")).when(said, F.col("kids_mean"))
        below = stable(cur.select(*keys, "node", m.alias("m"), v.alias("v"), "kids_mean", "kids_var", "kids_open"))
        ups.append(below)
    ups.reverse()
    done = [ups[0].select(*keys, "node", F.col("m").alias("final"), "kids_mean", "kids_var", "kids_open")]
    for level in range(1, depth + 1):
        gap = F.col("final") - F.coalesce("kids_mean", F.lit(0.0))
        p = done[-1].select(*keys, F.col("node").alias("parent"), gap.alias("gap"), F.col("kids_var").alias("PV"), F.col("kids_open").alias("open"))
        c = ups[level].join(edges, F.col("node") == F.col("child")).join(p, [*keys, "parent"])
        share = F.when((F.col("open") == 0) & (F.col("PV") > 0), F.col("weight") * F.col("v") / F.col("PV") * F.col("gap")).otherwise(0.0)
        alone = (F.col("open") == 1) & (F.col("weight") != 0)
        final = F.when(F.col("v").isNotNull(), F.col("m") + share).when(alone, F.col("gap") / F.col("weight"))
        done.append(c.select(*keys, "node", final.alias("final"), "kids_mean", "kids_var", "kids_open"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*keys, "node", F.col("final").alias("yhat"))


def reconcile_ols(fc: DataFrame, edges: DataFrame, keys: Sequence[str] = ("ts",)) -> DataFrame:
    return reconcile_wls(fc, edges, None, keys)


def variance_weights(fc: DataFrame, act: DataFrame) -> DataFrame:
    """Residual variance per node."""
    e = fc.join(act, ["ts", "node"]).select("node", (F.col("y") - F.col("yhat")).alias("e"))
    return e.groupBy("node").agg(F.when(F.count("e") > 1, F.greatest(F.var_samp("e"), F.lit(1e-10))).alias("var"))


def interval_weights(fc: DataFrame, z: float = 1.96) -> DataFrame:
    sd = F.avg((F.col("hi") - F.col("lo")) / (2 * z))
    return fc.groupBy("node").agg(F.greatest(sd * sd, F.lit(1e-10)).alias("var"))


def ensemble_weights(fc: DataFrame) -> DataFrame:
    """Variance between the models of one node and time, averaged over time."""
    v = fc.groupBy("ts", "node").agg(F.var_samp("yhat").alias("v"))
    return v.groupBy("node").agg(F.greatest(F.avg("v"), F.lit(1e-10)).alias("var"))


def confidence_weights(conf: DataFrame) -> DataFrame:
    """Confidence 0..1 per node."""
    return conf.groupBy("node").agg((1 / F.greatest(F.avg("confidence"), F.lit(1e-6))).alias("var"))


# --- covariance ------------------------------------------------------------------
def residuals(fc: DataFrame, act: DataFrame) -> DataFrame:
    return fc.join(act, ["ts", "node"]).select("ts", "node", (F.col("y") - F.col("yhat")).alias("e"))


def _vectors(df: DataFrame, names: Sequence[str], v: str, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """One array per key in the order of ``names``, null where a node is missing."""
    m = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col(v).isNotNull(), F.struct("node", v)))).alias("m"))  # one entry per node
    vec = F.array(*[F.try_element_at("m", F.lit(n)) for n in names])
    return m.select(*keys, vec.alias("x"))


def node_names(df: DataFrame) -> list[str]:
    names = [r[0] for r in df.select("node").distinct().orderBy("node").limit(DENSE_LIMIT + 1).collect()]
    if len(names) > DENSE_LIMIT:
        raise ValueError(f"more than {DENSE_LIMIT} nodes: a dense covariance does not fit, use reconcile_wls")
    return names


def cross_products(vectors: DataFrame, n: int) -> DataFrame:
    """(i, j, c, p, s): over the vectors with both entries, their number, the sums of the first and of the products."""

    def part(batches):
        acc = np.zeros((3, n, n))
        for pdf in batches:
            if len(pdf):
                x = np.array([[np.nan if e is None else e for e in row] for row in pdf["x"]], dtype=float)
                seen = (~np.isnan(x)).astype(float)
                x = np.nan_to_num(x)
                acc += np.stack([seen.T @ seen, x.T @ seen, x.T @ x])
        i, j = (k.ravel() for k in np.indices((n, n)))
        yield pd.DataFrame({"i": i.astype(np.int32), "j": j.astype(np.int32), "c": acc[0].ravel(), "p": acc[1].ravel(), "s": acc[2].ravel()})

    return vectors.select("x").mapInPandas(part, "i int, j int, c double, p double, s double").groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in "cps"])


def nearest_covariance(c: np.ndarray) -> np.ndarray:
    """A covariance from pairs of unequal samples need not be one: negative eigenvalues are lifted, variances kept."""
    w, u = np.linalg.eigh(c)
    if w[0] >= -1e-12 * max(w[-1], 0.0):
        return c
    made = (u * np.maximum(w, 1e-8 * w[-1])) @ u.T
    scale = np.sqrt(np.diag(c) / np.maximum(np.diag(made), 1e-300))
    return made * np.outer(scale, scale)


def residual_moments(res: DataFrame, v: str = "e") -> tuple[list[str], int, np.ndarray, np.ndarray]:
    """Names, count, means and covariance. Every pair of nodes uses all time stamps at which both have a
    residual; a pair without two in common counts as uncorrelated. Nodes with fewer than two residuals are left out."""
    enough = res.where(F.col(v).isNotNull()).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    names = node_names(enough)
    if not names:
        raise ValueError("no node has two residuals")
    p = cross_products(_vectors(res, names, v), len(names)).toPandas()
    count, first, prod = (np.zeros((len(names),) * 2) for _ in range(3))
    for m, k in ((count, "c"), (first, "p"), (prod, "s")):
        m[p["i"], p["j"]] = p[k]
    mean = np.diag(first) / np.diag(count)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.where(count > 1, (prod - first * first.T / count) / (count - 1), 0.0)
    return names, int(round(np.diag(count).max())), mean, nearest_covariance(c) if (count != count[0, 0]).any() else c


def _fourth(res: DataFrame, names, mean) -> float:
    """Sum over time of the squared norm, squared, of the centred residual vector."""
    m = res.sparkSession.createDataFrame([(a, float(b)) for a, b in zip(names, mean, strict=True)], "node string, mu double")
    d = F.col("e") - F.col("mu")
    q = res.join(m, "node").groupBy("ts").agg(F.sum(d * d).alias("q"), F.count("e").alias("c")).where("c > 0")
    full = F.col("q") * len(names) / F.col("c")  # as if the missing ones were like the rest
    return q.agg(F.sum(full * full)).head()[0]


def cov_table(spark, names, c: np.ndarray) -> DataFrame:
    i, j = np.indices(c.shape)
    pdf = pd.DataFrame({"node_i": np.array(names, dtype=object)[i.ravel()], "node_j": np.array(names, dtype=object)[j.ravel()], "c": c.ravel()})
    return spark.createDataFrame(pdf, "node_i string, node_j string, c double")


def factor_cov(c: np.ndarray, k: int = 1) -> np.ndarray:
    w, u = np.linalg.eigh(c)
    load = u[:, -k:] * np.sqrt(np.maximum(w[-k:], 0))
    common = load @ load.T
    return common + np.diag(np.maximum(np.diag(c) - np.diag(common), 1e-6))


def residual_cov(res: DataFrame, method: str = "sample", S: DataFrame | None = None, factors: int = 1) -> tuple[list[str], np.ndarray]:
    """Residual covariance (node names, matrix): sample, diagonal, identity, structural,
    ledoit_wolf, factor."""
    if method in ("identity", "structural"):
        names = node_names(res)
        if method == "identity":
            return names, np.eye(len(names))
        size = {r["node"]: r["n"] for r in S.groupBy("node").agg(F.sum("w").alias("n")).collect()}
        return names, np.diag([float(size[n]) for n in names])
    names, n, mean, c = residual_moments(res)
    if method == "sample":
        return names, c
    if method == "diagonal":
        return names, np.diag(np.diag(c))
    if method == "factor":
        return names, factor_cov(c, factors)
    if method != "ledoit_wolf":
        raise ValueError(f"unknown method {method!r}")
    p, b = len(names), c * (n - 1) / n
    mu = np.trace(b) / p
    delta = ((b - mu * np.eye(p)) ** 2).sum() / p
    beta = (_fourth(res, names, mean) / n - (b**2).sum()) / (n * p)
    lam = 0.0 if delta == 0 else min(max(beta, 0.0), delta) / delta
    return names, (1 - lam) * b + lam * mu * np.eye(p)


def cov_frame(res: DataFrame, method: str = "sample", S: DataFrame | None = None) -> DataFrame:
    names, c = residual_cov(res, method, S)
    return cov_table(res.sparkSession, names, c)


def shrink_target(c: np.ndarray, target: str) -> np.ndarray:
    n = len(c)
    if target == "identity":
        return np.trace(c) / n * np.eye(n)
    if target == "diagonal":
        return np.diag(np.diag(c))
    if target == "constant_correlation":
        sd = np.sqrt(np.diag(c))
        r = (np.sum(c / np.outer(sd, sd)) - n) / (n * (n - 1))
        t = r * np.outer(sd, sd)
        np.fill_diagonal(t, np.diag(c))
        return t
    if target == "factor":
        return factor_cov(c)
    raise ValueError(f"unknown shrinkage target {target!r}")


def shrink_cov(res: DataFrame, target: str = "diagonal", lam: float | str = "formula", lo: float = 0.0, hi: float = 1.0) -> tuple[list[str], np.ndarray, float]:
    """(names, covariance, intensity); ``lam`` is a number, ``formula`` or ``holdout`` (70 / 30 by time)."""
    names, n, mean, c = residual_moments(res)
    t = shrink_target(c, target)
    if lam == "formula":
        delta = ((c - t) ** 2).sum()
        sq = (c**2).sum()
        phi = (_fourth(res, names, mean) - 2 * (n - 1) * sq + n * sq) / n**2
        lam = 0.0 if delta < 1e-10 else float(np.clip(phi / (delta + 1e-10), 0.0, 1.0))
    elif lam == "holdout":
        p = positions(res.withColumn("__g", F.lit(1)), ["node"], "ts", name="__i", total="__n")
        cut = F.floor(F.col("__n") * 0.7)
        _, _, _, ct = residual_moments(p.where(F.col("__i") <= cut))
        _, _, _, cv = residual_moments(p.where(F.col("__i") > cut))
        tt = shrink_target(ct, target)
        grid = np.linspace(lo, hi, 11)
        lam = float(grid[np.argmin([np.linalg.norm((1 - g) * ct + g * tt - cv) for g in grid])])
    return names, (1 - lam) * c + lam * t, float(lam)


def _s_matrix(S: DataFrame, names: Sequence[str]) -> np.ndarray:
    rows = S.collect()
    leaves = sorted({r["leaf"] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    s = np.zeros((len(names), len(leaves)))
    for r in rows:
        if r["node"] in at:
            s[at[r["node"]], leaves.index(r["leaf"])] += r["w"]
    return s


def projection(S: np.ndarray, cov: np.ndarray, ridge: float = 1e-8, seen: np.ndarray | None = None) -> np.ndarray:
    """S (S' W^-1 S)^-1 S' W^-1, with the rows of the nodes that are ``seen`` only (a missing forecast
    says nothing). A node that the seen ones leave undetermined gets a row of NaN. The first rows of S are
    those of ``cov``; what follows are nodes without a covariance, which only receive values."""
    seen = np.ones(len(cov), dtype=bool) if seen is None else seen
    part, c = S[:len(cov)][seen], cov[np.ix_(seen, seen)]
    w = np.linalg.pinv(c + ridge * np.trace(cov) / len(cov) * np.eye(len(c)))
    out = S @ np.linalg.pinv(part.T @ w @ part) @ part.T @ w
    known = np.abs(S @ np.linalg.pinv(part) @ part - S).max(axis=1, initial=0.0) < 1e-8
    out[~known] = np.nan
    return out


PATTERNS = 64  # sets of missing nodes whose matrix a task keeps


def apply_projection(fc: DataFrame, names: Sequence[str], S: np.ndarray, cov: np.ndarray, keys: Sequence[str] = ("ts",), also: Sequence[str] = ()) -> DataFrame:
    """Matrix times the node vectors of a batch of keys; each forecast is shuffled once.

    Every key of the input has a row per node, those of ``also`` (further rows of S) included. Keys with the
    same nodes missing share a matrix, made on the worker; undetermined nodes are null.
    """
    vec = _vectors(fc, names, "yhat", keys)
    types = dict(vec.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", x array<double>"

    def part(batches):
        made: dict[bytes, np.ndarray] = {}
        for pdf in batches:
            if len(pdf):
                x = np.array([[np.nan if e is None else e for e in row] for row in pdf["x"]], dtype=float)
                out = np.empty((len(x), len(S)))
                seen, which = np.unique(~np.isnan(x), axis=0, return_inverse=True)
                for i, mask in enumerate(seen):
                    if (key := mask.tobytes()) not in made:
                        if len(made) >= PATTERNS:
                            made.clear()
                        made[key] = projection(S, cov, seen=mask)
                    rows = which.ravel() == i
                    out[rows] = x[rows][:, mask] @ made[key].T if mask.any() else np.nan
                pdf["x"] = [[None if np.isnan(e) else e for e in row] for row in out.tolist()]
            yield pdf

    out = vec.mapInPandas(part, schema)
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in [*names, *also]]).alias("node"), F.col("x").alias("yhat"))
    return out.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.col("p.node").alias("node"), F.col("p.yhat").alias("yhat"))


def _by_matrix(fc: DataFrame, S: DataFrame, names: Sequence[str], c: np.ndarray, keys: Sequence[str]) -> DataFrame:
    """Nodes that have no residual have no weight; they get what the others determine."""
    also = [n for n in node_names(S) if n not in set(names)]
    return apply_projection(fc, names, _s_matrix(S, [*names, *also]), c, keys, also)


def reconcile_mint(fc: DataFrame, S: DataFrame, res: DataFrame, method: str = "sample", keys: Sequence[str] = ("ts",)) -> DataFrame:
    return _by_matrix(fc, S, *residual_cov(res, method, S), keys)


def reconcile_shrink(fc: DataFrame, S: DataFrame, res: DataFrame, target: str = "diagonal", lam: float | str = "formula", keys: Sequence[str] = ("ts",)) -> DataFrame:
    return _by_matrix(fc, S, *shrink_cov(res, target, lam)[:2], keys)


def reconcile_factors(fc: DataFrame, edges: DataFrame, res: DataFrame, factors: int = 1, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """MinT with common factors and specific variances, for any number of nodes up to ``treesolve.NODES``.

    The covariance comes from all residuals by EM; the tree and a factors x factors system per set
    of missing nodes solve it. A forecast of a node that has no residual has no weight.
    """
    edges = stable(edges.select("parent", "child", "weight"))
    tree = X.make_tree(stable(_levels(edges)), edges)
    if tree is None:
        raise ValueError(f"more than {X.NODES} nodes: use reconcile_wls")
    model = X.fit_factors(res, tree, factors)
    known = fc.sparkSession.createDataFrame([(n,) for n, v in zip(tree.names, model.var, strict=True) if np.isfinite(v)], "node string")
    trusted = fc.join(known.withColumn("__known", F.lit(True)), "node", "left").withColumn("yhat", F.when(F.col("__known"), F.col("yhat")))
    return X.reconcile(trusted, tree, keys, np.where(np.isfinite(model.var), model.var, 1.0), model.loadings)


def reconcile_proportional(fc: DataFrame, edges: DataFrame, root: str, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Direct children of ``root`` scaled to its forecast; other nodes unchanged."""
    keys = list(keys)
    kids = edges.where(F.col("parent") == root).select(F.col("child").alias("node")).withColumn("__kid", F.lit(True))
    x = fc.join(kids, "node", "left")
    tot = x.groupBy(*keys).agg(F.sum(F.when(F.col("__kid"), F.col("yhat"))).alias("__s"), F.max(F.when(F.col("node") == root, F.col("yhat"))).alias("__r"))
    ok = F.col("__kid") & (F.col("__s") > 0) & F.col("__r").isNotNull()
    y = F.when(ok, F.col("yhat") * F.col("__r") / F.col("__s")).otherwise(F.col("yhat"))
    return x.join(tot, keys).select(*keys, "node", y.alias("yhat"))


# --- constraints -----------------------------------------------------------------
def constraint_table(edges: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """(constraint, node, coef): parent - sum of children, and generation - consumption - losses."""
    kids = edges.select(F.concat(F.lit("agg:"), "parent").alias("constraint"), F.col("child").alias("node"), (-F.col("weight")).alias("coef"))
    top = edges.select(F.concat(F.lit("agg:"), "parent").alias("constraint"), F.col("parent").alias("node"), F.lit(1.0).alias("coef")).distinct()
    out = kids.unionByName(top)
    if roles is not None:
        sign = F.when(F.col("role") == "generation", 1.0).otherwise(-1.0)
        out = out.unionByName(roles.select(F.lit("energy").alias("constraint"), "node", sign.alias("coef")))
    return out


def check_constraints(fc: DataFrame, constraints: DataFrame, tol: float = 1e-6, floor: float | None = 0.0) -> DataFrame:
    """Largest violation per constraint, and of the floor."""
    v = fc.join(constraints, "node").groupBy("ts", "constraint").agg(F.abs(F.sum(F.col("coef") * F.col("yhat"))).alias("v"))
    out = v.groupBy("constraint").agg(F.max("v").alias("max_violation"), F.avg("v").alias("mean_violation"))
    if floor is not None:
        below = F.greatest(F.lit(floor) - F.col("yhat"), F.lit(0.0))
        out = out.unionByName(fc.agg(F.lit("floor").alias("constraint"), F.max(below).alias("max_violation"), F.avg(below).alias("mean_violation")))
    return out.withColumn("satisfied", F.col("max_violation") <= tol)


def enforce_constraints(fc: DataFrame, S: DataFrame, roles: DataFrame | None = None, tol: float = 1e-6, floor: float = 0.0, patience: int = 5) -> DataFrame:
    """Floor on leaves, sums upward, loss nodes scaled to generation - consumption; repeated
    until the largest change is below ``tol``. A change that doesn't shrink for ``patience`` rounds is an
    error: the constraints contradict each other. Lineage is cut by a written table per round."""
    leaves = S.select(F.col("leaf").alias("node")).distinct()
    tree = S.select("node").distinct()
    cur = fc.select("ts", "node", "yhat")
    best, stuck = float("inf"), 0
    while True:
        low = cur.withColumn("yhat", F.greatest("yhat", F.lit(floor)))
        up = bottom_up(low.join(leaves, "node", "left_semi"), S)
        nxt = up.unionByName(low.join(tree, "node", "left_anti"))
        if roles is not None:
            x = nxt.join(roles, "node", "left")
            part = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("yhat"))), F.lit(0.0))
            need = x.groupBy("ts").agg((part("generation") - part("consumption")).alias("__need"), part("losses").alias("__have"),
                                       F.count_if(F.coalesce(F.col("role") == "losses", F.lit(False))).alias("__k"))
            share = F.when(F.col("__have") > 0, F.col("yhat") / F.col("__have")).otherwise(1 / F.col("__k"))
            y = F.when(F.col("role") == "losses", F.greatest(share * F.col("__need"), F.lit(floor))).otherwise(F.col("yhat"))
            nxt = x.join(need, "ts").select("ts", "node", y.alias("yhat"))
        nxt = stable(nxt)
        change = nxt.join(cur.withColumnRenamed("yhat", "o"), ["ts", "node"]).agg(F.max(F.abs(F.col("yhat") - F.col("o")))).head()[0] or 0.0
        cur = nxt
        if change < tol:
            return cur
        best, stuck = (change, 0) if change < best else (best, stuck + 1)
        if stuck >= patience:
            raise ValueError(f"constraints not met: values still change by {change:g}")


# --- quality ---------------------------------------------------------------------
def _three(base: DataFrame, rec: DataFrame, act: DataFrame) -> DataFrame:
    return (base.select("ts", "node", F.col("yhat").alias("b")).join(rec.select("ts", "node", F.col("yhat").alias("r")), ["ts", "node"])
            .join(act.select("ts", "node", "y"), ["ts", "node"]))


def _err(c: str) -> list[Column]:
    e = F.col("y") - F.col(c)
    return [100 * F.avg(F.when(F.col("y") != 0, F.abs(e / F.col("y")))), F.avg(F.abs(e)), F.sqrt(F.avg(e * e))]


def recon_quality(base: DataFrame, rec: DataFrame, act: DataFrame, edges: DataFrame, tol: float = 1e-6) -> DataFrame:
    x = _three(base, rec, act)
    names = ("mape", "mae", "rmse")
    m = x.agg(*[e.alias(f"{n}_base") for n, e in zip(names, _err("b"), strict=True)], *[e.alias(f"{n}_reconciled") for n, e in zip(names, _err("r"), strict=True)])
    v = child_sums(rec, edges).groupBy("node").agg(F.avg(F.abs(F.col("yhat") - F.col("expected"))).alias("v"))
    v = v.agg(F.max("v").alias("max_violation"), F.avg("v").alias("mean_violation"))
    imp = F.when(F.col("mape_base") > 0, F.greatest(F.least((F.col("mape_base") - F.col("mape_reconciled")) / F.col("mape_base"), F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)
    sat = F.when(F.col("max_violation") <= tol, 1.0).otherwise(F.exp(-F.col("max_violation") / 10))
    return m.join(v).withColumns({"satisfaction": sat, "improvement": imp})  # two frames of one row


def recon_consistency(base: DataFrame, rec: DataFrame) -> DataFrame:
    """0.5 preserved correlations + 0.5 correlation of first differences."""
    names, _, _, cb = residual_moments(base.select("ts", "node", F.col("yhat").alias("e")))
    _, _, _, cr = residual_moments(rec.join(base.select("node").distinct(), "node", "left_semi").select("ts", "node", F.col("yhat").alias("e")))
    cor = lambda c: c / np.sqrt(np.outer(np.diag(c), np.diag(c)))
    keep = max(0.0, 1.0 - float(np.nanmean(np.abs(cor(cb) - cor(cr))))) if len(names) > 1 else 1.0
    j = base.select("ts", "node", F.col("yhat").alias("b")).join(rec.select("ts", "node", F.col("yhat").alias("r")), ["ts", "node"])
    d = bounded(j, ["node"], "ts", lambda w: {"db": F.col("b") - F.lag("b").over(w), "dr": F.col("r") - F.lag("r").over(w)}, back=1)
    s = d.groupBy("node").agg(correlation("db", "dr").alias("c")).where("c is not null and not isnan(c)").agg(F.coalesce(F.avg(F.greatest("c", F.lit(0.0))), F.lit(1.0)).alias("temporal_stability"))
    return s.select(F.lit(keep).alias("correlation_preservation"), "temporal_stability", (0.5 * F.lit(keep) + 0.5 * F.col("temporal_stability")).alias("consistency"))


def stack_methods(methods: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, d in methods.items():
        d = d.select(F.lit(name).alias("method"), "ts", "node", "yhat")
        out = d if out is None else out.unionByName(d)
    return out


def compare_recon(methods: Mapping[str, DataFrame], act: DataFrame, folds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(scores with rank over time folds, pairwise t and Wilcoxon tests of absolute errors)."""
    x = stack_methods(methods).join(act, ["ts", "node"])
    f = time_folds(x, folds, 0, "ts", ["method", "node"]).where("fold >= 1")
    m = metrics(f, ["method", "fold"], symmetric=False).groupBy("method").agg(
        F.avg("mape").alias("mape"), F.stddev_pop("mape").alias("mape_std"), F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"))
    ranked = m.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("mape", "method")))  # one row per method
    from wattline.operators.compare import pair_rows

    r = pair_rows(x.withColumnRenamed("method", "model"), list(methods), ("ts", "node"))
    r = r.withColumns({"a": F.abs(F.col("y") - F.col("yhat_a")), "b": F.abs(F.col("y") - F.col("yhat_b"))})
    keys = ["model_a", "model_b"]
    t = T.paired_t(r, keys).select(*keys, "n", "mean_diff", "t", F.col("p_value").alias("t_p"))
    return ranked, t.join(T.wilcoxon(r, keys).select(*keys, F.col("p_value").alias("wilcoxon_p")), keys, "left")


def select_recon(methods: Mapping[str, Callable[[], DataFrame]], act: DataFrame, S: DataFrame, weights: tuple[float, float, float] = (0.6, 0.3, 0.1),
                 history: DataFrame | None = None, mape_threshold: float = 5.0, tolerance: float = 1e-6, target_seconds: float = 5.0) -> DataFrame:
    """Weighted accuracy, coherence and time score per method; with earlier rounds as history
    the mean over rounds decides."""
    rows = []
    for name, make in methods.items():
        start = time.perf_counter()
        fc = stable(make())
        secs = time.perf_counter() - start
        mape = metrics(fc.join(act, ["ts", "node"]), [], symmetric=False).head()["mape"] / 100
        err = coherence(fc, S).head()["max_violation"]
        acc = 1.0 if mape <= 0 else 0.0 if mape >= 1 else float(np.exp(-mape * 100 / mape_threshold * np.log(2)))
        con = 1.0 if err <= tolerance else float(np.exp(-err / 100))
        eff = float(1 / (1 + np.exp((secs - target_seconds) / target_seconds)))
        rows.append((name, acc, con, eff, float(np.dot(weights, (acc, con, eff)))))
    s = act.sparkSession.createDataFrame(rows, "method string, accuracy double, coherence double, efficiency double, score double")
    hist = s.select("method", "score")
    if history is not None:
        hist = hist.unionByName(history.select("method", "score"))
    r = hist.groupBy("method").agg(F.avg("score").alias("rolling_score"))
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("rolling_score").desc(), "method")  # one row per method
    return s.join(r, "method").withColumn("rank", F.row_number().over(w))


def recon_degradation(hist: DataFrame, by: Sequence[str], v: str = "improvement", t: str = "ts", n: int = 10, threshold: float = -0.01, alpha: float = 0.05) -> DataFrame:
    """Slope of the last ``n`` values, its t-test, and whether it is a significant decline."""
    p = positions(hist.where(F.col(v).isNotNull()), by, t, name="__i", total="__n").where(F.col("__i") > F.col("__n") - n)
    x = F.col("__i").cast("double")
    g = p.groupBy(*by).agg(F.regr_slope(F.col(v), x).alias("slope"), F.regr_r2(F.col(v), x).alias("r2"), F.count(v).alias("n"))
    g = g.withColumn("__t", F.sqrt(F.col("r2") * (F.col("n") - 2) / F.greatest(1 - F.col("r2"), F.lit(1e-12))))
    g = g.withColumn("p_value", tails.p_t(F.col("__t"), F.col("n") - 2)).drop("__t")
    return g.withColumn("is_degrading", (F.col("slope") < threshold) & (F.col("p_value") < alpha))


def recon_impact(base: DataFrame, rec: DataFrame, act: DataFrame) -> DataFrame:
    x = _three(base, rec, act).groupBy("node").agg(_err("b")[0].alias("mape_before"), _err("r")[0].alias("mape_after"))
    return x.withColumn("mape_change", F.col("mape_after") - F.col("mape_before"))


def national_check(rec: DataFrame, edges: DataFrame, root: str, tol: float = 0.001) -> DataFrame:
    s = child_sums(rec, edges).where(F.col("node") == root)
    rel = F.abs(F.col("yhat") - F.col("expected")) / F.greatest(F.abs("yhat"), F.lit(1e-8))
    return s.agg(F.max(rel).alias("max_relative_gap"), F.count_if(rel > tol).alias("violations")).withColumn("ok", F.col("violations") == 0)


def compare_ols_mint(fc: DataFrame, act: DataFrame, edges: DataFrame, S: DataFrame) -> DataFrame:
    res = stable(residuals(fc, act))
    both = stack_methods({"ols": reconcile_ols(fc, edges), "mint": reconcile_mint(fc, S, res)})
    m = metrics(both.join(act, ["ts", "node"]), ["method"], symmetric=False).select("method", "mape", "mae")
    return m.join(coherence(both, S, ["ts", "method"]), "method")


def recon_tests(base: DataFrame, rec: DataFrame, act: DataFrame) -> DataFrame:
    """One-sided paired tests of the per-node MAE: is the reconciled error smaller."""
    x = _three(base, rec, act)
    g = x.groupBy("node").agg(F.avg(F.abs(F.col("y") - F.col("b"))).alias("a"), F.avg(F.abs(F.col("y") - F.col("r"))).alias("b")).withColumn("g", F.lit("all"))
    t = T.paired_t(g, ["g"])
    w = T.wilcoxon(g, ["g"])
    half = lambda stat, p: F.when(stat, F.col(p) / 2).otherwise(1 - F.col(p) / 2)
    t = t.select("g", "n", "mean_diff", "t", half(F.col("t") > 0, "p_value").alias("t_p_one_sided"))
    total = F.col("n") * (F.col("n") + 1) / 4
    w = w.select("g", "w_plus", half(F.col("w_plus") > total, "p_value").alias("wilcoxon_p_one_sided"))
    return t.join(w, "g").drop("g")

"""Reconciliation with missing nodes against numpy."""

import numpy as np
import pytest

from wattline.operators import hierarchy as H
from wattline.operators import reconcile as R
from wattline.operators import treesolve as X

NAMES = list("TABabcde")
PARENT = np.array([-1, 0, 0, 1, 1, 2, 2, 2])
WEIGHT = np.array([0, 1, 1, 1, 2.0, 1, 0.5, 1])
TREE = X.Tree(NAMES, PARENT, WEIGHT, [np.array([0]), np.array([1, 2]), np.array([3, 4, 5, 6, 7])])


def summing():
    s = np.zeros((8, 5))
    for j in range(5):
        i, c = j + 3, 1.0
        while i >= 0:
            s[i, j] = c
            c *= WEIGHT[i]
            i = PARENT[i]
    return s


def formula(s, v, x):
    """(values, which are determined) of generalised least squares with the seen entries."""
    seen = ~np.isnan(x)
    part = s[seen]
    known = np.abs(s @ np.linalg.pinv(part) @ part - s).max(axis=1, initial=0.0) < 1e-8
    w = np.linalg.pinv(v[np.ix_(seen, seen)])
    return s @ np.linalg.pinv(part.T @ w @ part) @ part.T @ w @ x[seen], known


@pytest.mark.parametrize("factors", [0, 1, 3])
def test_tree_solver_equals_matrices(factors):
    rng, s = np.random.default_rng(factors), summing()
    for _ in range(400):
        x = rng.normal(size=(3, 8))
        x[:, rng.random(8) < 0.7 * rng.random()] = np.nan
        x[0, rng.integers(0, 8)] = np.nan
        var, load = rng.uniform(0.5, 4, 8), rng.normal(size=(8, factors))
        got = X.solve_factors(x, var, load, TREE)
        for row, out in zip(x, got, strict=True):
            want, known = formula(s, np.diag(var) + load @ load.T, row)
            assert (~np.isnan(out) == known).all() and np.allclose(out[known], want[known], atol=1e-6)


@pytest.fixture(scope="module")
def data(spark):
    rng, s = np.random.default_rng(5), summing()
    t = 250
    load = np.array([3.0, 2, 2, 1, 1, 1, 1, 1])
    y = s @ rng.normal(20, 3, (5, t))
    err = load[:, None] * rng.normal(0, 1, t) + rng.normal(0, 1, (8, t)) * np.array([2.0, 1, 1, 1, 1, 1, 1, 1])[:, None]
    fc = y + err
    fc[rng.random(fc.shape) < 0.1] = np.nan
    fc[7] = np.nan  # never forecast: determined by the rest
    edges = spark.createDataFrame([(NAMES[p], n, float(w)) for n, p, w in zip(NAMES, PARENT, WEIGHT, strict=True) if p >= 0], "parent string, child string, weight double")
    table = lambda m, c: spark.createDataFrame([(i, n, None if np.isnan(m[k, i]) else float(m[k, i])) for i in range(t) for k, n in enumerate(NAMES)], f"ts int, node string, {c} double")
    return edges, table(fc, "yhat"), table(y, "y"), fc, fc * 0 + (y - fc)


def block(df):
    out = np.full((8, 250), np.nan)
    n = 0
    for r in df.collect():
        n += 1
        if r["yhat"] is not None:
            out[NAMES.index(r["node"]), r["ts"]] = r["yhat"]
    assert n == 2000  # a row for every node and time stamp
    return out


def test_every_method_keeps_incomplete_time_stamps(data):
    """Pairwise covariance where it is one; nodes without a residual get what the others determine."""
    edges, fc, y, x, res = data
    s, S = summing(), H.summation_matrix(edges)
    own = ~np.isnan(res).all(axis=1)
    seen = (~np.isnan(res[own])).astype(float)
    e = np.nan_to_num(res[own])
    n = seen @ seen.T
    cov = np.eye(8)
    cov[np.ix_(own, own)] = (e @ e.T - (e @ seen.T) * (seen @ e.T) / n) / (n - 1)
    target = np.diag(np.diag(cov))
    names, c, lam = R.shrink_cov(R.residuals(fc, y))
    assert names == sorted(n for n, o in zip(NAMES, own, strict=True) if o) and 0 <= lam <= 1
    order = [NAMES.index(n) for n in names]
    assert np.allclose(c, (1 - lam) * cov[np.ix_(order, order)] + lam * target[np.ix_(order, order)])
    made = {
        "mint": (block(R.reconcile_mint(fc, S, R.residuals(fc, y))), cov), "shrink": (block(R.reconcile_shrink(fc, S, R.residuals(fc, y))), (1 - lam) * cov + lam * target),
        "ols": (block(R.reconcile_ols(fc, edges)), np.eye(8)),
    }
    for name, (got, v) in made.items():
        for t in range(250):
            want, known = formula(s, v, x[:, t])
            assert (~np.isnan(got[:, t]) == known).all(), (name, t)
            assert np.allclose(got[known, t], want[known], atol=1e-3), (name, t)


def test_factor_reconciliation(spark, data):
    edges, fc, y, x, _ = data
    tree = X.make_tree(H.levels(H.closure(edges)), edges)
    at = [tree.at[n] for n in NAMES]
    model = X.fit_factors(R.residuals(fc, y), tree, 1)
    load, var = model.loadings[at, 0], model.var[at]
    assert np.isinf(var[7]) and load[7] == 0
    assert np.allclose(np.abs(load[:7]), [3, 2, 2, 1, 1, 1, 1], atol=0.35) and np.allclose(var[:7], [4, 1, 1, 1, 1, 1, 1], atol=0.6)
    got = block(R.reconcile_factors(fc, edges, R.residuals(fc, y)))
    v = np.diag(np.where(np.isinf(var), 1.0, var)) + np.outer(load, load)
    for t in range(250):
        want, known = formula(summing(), v, x[:, t])
        assert (~np.isnan(got[:, t]) == known).all() and np.allclose(got[known, t], want[known], atol=1e-6)


def test_level_by_level_equals_vectors(data, monkeypatch):
    """The path for trees beyond the size of a vector."""
    edges, fc, _, _, _ = data
    want = block(R.reconcile_ols(fc, edges))
    monkeypatch.setattr(X, "make_tree", lambda *a, **k: None)
    assert np.allclose(block(R.reconcile_ols(fc, edges)), want, equal_nan=True)


def test_variances_per_key(spark, data):
    edges, fc, _, x, _ = data
    rng = np.random.default_rng(1)
    var = rng.uniform(0.5, 3, (8, 250))
    w = spark.createDataFrame([(t, n, float(var[k, t])) for t in range(250) for k, n in enumerate(NAMES)], "ts int, node string, var double")
    got = block(R.reconcile_wls(fc, edges, w))
    for t in range(0, 250, 10):
        want, known = formula(summing(), np.diag(var[:, t]), x[:, t])
        assert np.allclose(got[known, t], want[known], atol=1e-6)


def test_pairwise_covariance_is_repaired():
    c = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    made = R.nearest_covariance(c)
    assert np.linalg.eigvalsh(made)[0] > 0 and np.allclose(np.diag(made), 1)
    assert R.nearest_covariance(np.eye(3)) is not None and np.allclose(R.nearest_covariance(np.eye(3)), np.eye(3))


def test_a_nation_without_orders(spark, tmp_path):
    """The default queries return a row per node and day."""
    from wattline.plans import q_hierarchy as Q
    from wattline.plans.registry import QUERIES

    for t in ("region", "nation", "orders", "customer"):
        d = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        (d.where("c_nationkey <> 3") if t == "customer" else d).write.parquet(f"{tmp_path}/{t}.parquet")
    root = str(tmp_path)
    f, y = Q.every_fc(spark, root)
    days = y.select("ts").distinct().count()
    gone = spark.read.parquet(f"{root}/nation.parquet").where("n_nationkey = 3").head()["n_name"]
    determined = {}
    for name in ("h14_reconcile_ols", "h15_reconcile_wls", "h16_reconcile_mint", "h17_reconcile_shrink", "h16_reconcile_factors", "h18_reconcile_proportional", "k27_predict_job"):
        got = QUERIES[name](spark, root)
        assert got.count() == 31 * days, name
        determined[name] = got.where(f"yhat is not null and node = '{gone}'").count()
    assert determined["h14_reconcile_ols"] == determined["h15_reconcile_wls"] == determined["h16_reconcile_mint"] == determined["h17_reconcile_shrink"] == determined["h16_reconcile_factors"] > 2000

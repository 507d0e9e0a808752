"""Invariants of operators that plain SQL does not express."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.functions import tails
from wattline.operators import combine as C
from wattline.operators import decompose as X
from wattline.operators import hierarchy as H
from wattline.operators import impute as I
from wattline.operators import metrics as M
from wattline.operators import profiles as P
from wattline.operators import quality as Q
from wattline.operators import reconcile as R
from wattline.operators import selection as S
from wattline.sources import readers


def test_tail_values():
    assert abs(tails.t_two_sided(2.228, 10) - 0.05) < 1e-4
    assert abs(tails.f_upper(3.326, 5, 10) - 0.05) < 2e-4
    assert abs(tails.gamma_upper(2.5, 11.0705 / 2) - 0.05) < 1e-5
    assert abs(tails.normal_cdf(1.959964) - 0.975) < 1e-6
    assert abs(tails.t_quantile(0.95, 10) - 2.228139) < 1e-5


def edges(spark):
    rows = [("Total", "North"), ("Total", "South"), ("North", "A"), ("North", "B"), ("South", "C"), ("South", "D")]
    return spark.createDataFrame([(p, c, 1.0) for p, c in rows], "parent string, child string, weight double")


NODES = ["A", "B", "C", "D", "North", "South", "Total"]
SM = np.array([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1], [1, 1, 0, 0], [0, 0, 1, 1], [1, 1, 1, 1]], float)


def test_reconciliation_equals_matrix_formula(spark):
    rng = np.random.default_rng(3)
    y = SM @ rng.normal(100, 10, (4, 60)) + rng.normal(0, 8, (7, 60))
    act = SM @ rng.normal(100, 10, (4, 60))
    table = lambda m, c: spark.createDataFrame([(t, n, float(m[i, t])) for t in range(60) for i, n in enumerate(NODES)], f"ts int, node string, {c} double")
    fc, ac = table(y, "yhat"), table(act, "y")
    e = edges(spark)
    var = np.array([25.0, 30, 15, 40, 50, 20, 100])
    w = spark.createDataFrame([(n, float(v)) for n, v in zip(NODES, var)], "node string, var double")

    def matrix(df):
        out = np.zeros((7, 60))
        for r in df.collect():
            out[NODES.index(r["node"]), r["ts"]] = r["yhat"]
        return out

    formula = lambda v: SM @ np.linalg.solve(SM.T @ np.linalg.inv(v) @ SM, SM.T @ np.linalg.inv(v) @ y)
    assert np.allclose(matrix(R.reconcile_ols(fc, e)), formula(np.eye(7)))
    assert np.allclose(matrix(R.reconcile_wls(fc, e, w)), formula(np.diag(var)))
    S = H.summation_matrix(e)
    mint = R.reconcile_mint(fc, S, R.residuals(fc, ac))
    assert np.allclose(matrix(mint), formula(np.cov(act - y)), atol=1e-3)
    assert R.coherence(mint, S).head()["max_violation"] < 1e-6
    good = table(SM @ rng.normal(100, 10, (4, 60)), "yhat")
    assert np.allclose(matrix(R.reconcile_ols(good, e)), matrix(good))


def test_wavelet_adds_up_and_loess_keeps_lines(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(10, 3, 101)
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame([("a", i, float(v), 2.0 * i + 1) for i, v in enumerate(x)], "area string, i int, load double, line double")
    df = df.withColumn("ts", t0 + F.make_dt_interval(mins=F.col("i") * 30))
    for name, level in (("haar", 2), ("db2", 3), ("db4", 2)):
        w = X.wavelet(df, wavelet=name, level=level)
        total = sum((F.col(f"load_detail_{k}") for k in range(1, level + 1)), F.col("load_approx"))
        assert w.agg(F.max(F.abs(total - F.col("load")))).head()[0] < 1e-9
    s = X.loess(df, "line", frac=0.2, iterations=2)
    assert s.agg(F.max(F.abs("line_residual"))).head()[0] < 1e-6


def test_weights_and_holt_winters(spark):
    rng = np.random.default_rng(7)
    rows = []
    for t in range(300):
        y = rng.normal(100, 10)
        rows += [(t, "z", 1, m, float(y + rng.normal(0, s)), float(y)) for m, s in (("a", 1), ("b", 3), ("c", 6))]
    df = spark.createDataFrame(rows, "ts int, area string, horizon int, model string, yhat double, y double")
    for w in (C.weights_min_mse(df, ["a", "b", "c"]), C.weights_min_mae(df, ["a", "b", "c"]), C.weights_inverse_error(df)):
        v = {r["model"]: r["weight"] for r in w.collect()}
        assert abs(sum(v.values()) - 1) < 1e-6 and v["a"] > v["b"] > v["c"] - 1e-9
    ci = M.bootstrap_ci(df, ["model"], ["ts"], n=200).join(M.metrics(df, ["model"]), "model").collect()
    assert all(r["mae_lo"] < r["mae"] < r["mae_hi"] for r in ci)
    season = [0, 5, 10, 3, -4, -8, -6]
    d = spark.createDataFrame([("a", i, 100 + 0.5 * i + season[i % 7]) for i in range(140)], "area string, ts int, load double")
    for r in P.fit_daily_hw(d, horizons=[1, 2, 3]).collect():
        i = 139 + r["horizon"]
        assert abs(r["yhat"] - (100 + 0.5 * i + season[i % 7])) < 1.5


def test_planted_feature_and_synthetic_series(spark):
    d = Q.synth_series(spark, ["a", "b"], 20)
    assert d.count() == 2 * 20 * 48 and d.where("load is null").count() == 0
    x = d.withColumns({"good": F.col("load") * 2, "noise": F.rand(1), "target": F.col("load")})
    imp = S.select_by_importance(x.select("good", "noise", "target"), "target", ["good", "noise"], 1, min_features=1, threshold=0.5).collect()
    assert [r["feature"] for r in imp] == ["good"]
    assert S.safe_features(["hour", "x_lag_24", "x_lag_96", "future_x", "y"], 2, 48, "y") == ["hour", "x_lag_96"]
    rep = S.leakage_report(spark, ["hour", "x_lag_24"], 2, 48).where("not is_safe").collect()
    assert [r["reason"] for r in rep] == ["lag"]


def test_raw_layout_and_strict_rules(spark, tmp_path):
    import pandas as pd

    for day in ("20240101", "20240102", "20240103"):
        for area in ("SP", "RJ"):
            p = tmp_path / "2024" / "01"
            p.mkdir(parents=True, exist_ok=True)
            pd.DataFrame({"data_hora": pd.date_range(day, periods=3, freq="30min").astype("datetime64[us]"), "area": area, "carga": [1.0, 2.0, 3.0]}).to_parquet(p / f"carga_{area}_{day}.parquet")
    got = readers.scan_load(spark, str(tmp_path), ["SP"], "2024-01-01", "2024-01-02", layout="raw")
    assert got.count() == 6 and got.columns == ["timestamp", "cod_area", "carga_mwh"]
    dated = readers.scan_dated_files(spark, str(tmp_path), "2024-01-02", "2024-01-03")
    assert dated.count() == 12
    bad = spark.createDataFrame([("SP", -1.0)], "area string, load double")
    with pytest.raises(Exception, match="invalid row"):
        Q.validate(bad, Q.load_rules(["SP"]), strict=True)[0].collect()


def test_fill_examples(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 10.0, None, 20.0, None, None, 30.0, None])], "area string, i int, load double")
    df = df.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("i") * 30))
    vals = lambda d: [None if r[0] is None else round(r[0], 3) for r in d.orderBy("i").select("load").collect()]
    assert vals(I.interpolate(df, "load")) == [None, 10, 15, 20, 23.333, 26.667, 30, 30]
    assert vals(I.fill_both(df, "load")) == [10, 10, 15, 20, 23.333, 26.667, 30, 30]
    assert math.isclose(M.metrics(spark.createDataFrame([(100.0, 90.0), (200.0, 220.0)], "y double, yhat double"), []).head()["mae"], 15.0)


def test_stream_drift_over_batches_equals_one_batch(spark, tmp_path):
    from wattline.streaming import feeds

    rows = [("a", i, float((i * 7919) % 101)) for i in range(120)]
    df = spark.createDataFrame(rows, "area string, id bigint, value double").withColumn("ts", (F.lit(1704067200) + F.col("id") * 60).cast("timestamp"))
    out = []
    for name, parts in (("one", 1), ("many", 4)):
        src = str(tmp_path / name)
        for k in range(parts):
            df.where((F.col("id") >= k * 120 // parts) & (F.col("id") < (k + 1) * 120 // parts)).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        table = str(tmp_path / f"{name}-state")
        feeds.stream_drift(stream, table, 50.0, 30.0)
        r = feeds.latest(spark, table, "state").head()
        out.append((round(r["page_hinkley"], 6), round(r["max_cusum"], 6), r["n"]))
    assert out[0] == out[1] and out[0][2] == 120


def test_projection_with_missing_nodes(spark):
    """A key with a missing node has a row per node, equal to the projection of the nodes it has."""
    import pandas as pd

    from wattline.operators.reconcile import reconcile_mint, residuals

    rng = np.random.default_rng(3)
    names = ["T", "a", "b"]
    s = np.array([[1, 1], [1, 0], [0, 1]], dtype=float)
    act = pd.DataFrame([(t, n, float(v)) for t in range(40) for n, v in zip(names, s @ rng.uniform(5, 9, 2))], columns=["ts", "node", "y"])
    fc = act.assign(yhat=act.y + rng.normal(size=len(act))).drop(columns="y")
    a, f = spark.createDataFrame(act), spark.createDataFrame(fc)
    S = spark.createDataFrame([("T", "a", 1.0), ("T", "b", 1.0), ("a", "a", 1.0), ("b", "b", 1.0)], "node string, leaf string, w double")
    gone = fc[~((fc.ts == 3) & (fc.node == "b")) & ~((fc.ts == 4) & (fc.node != "a"))]
    got = reconcile_mint(spark.createDataFrame(gone), S, residuals(f, a)).toPandas().set_index(["ts", "node"]).yhat
    assert len(got) == 120
    wide = (act.set_index(["ts", "node"]).y - fc.set_index(["ts", "node"]).yhat).unstack()[names]
    c = np.cov(wide.to_numpy().T)
    w = np.linalg.inv(c[:2, :2] + 1e-8 * np.trace(c) / 3 * np.eye(2))
    part = s[:2]
    y = fc.set_index(["ts", "node"]).yhat
    want = s @ np.linalg.solve(part.T @ w @ part, part.T @ w @ np.array([y[3, "T"], y[3, "a"]]))
    assert np.allclose([got[3, n] for n in names], want)
    assert np.isnan(got[4, "b"]) and np.isnan(got[4, "T"]) and abs(got[4, "a"] - y[4, "a"]) < 1e-6
    assert all(abs(got[t, "T"] - got[t, "a"] - got[t, "b"]) < 1e-6 for t in range(40) if t != 4)


def test_reconcile_incomplete_queries(spark, tmp_path):
    """A nation without orders: the queries still return every node of every day, equal to numpy."""
    from wattline.operators import reconcile as R
    from wattline.plans import q_hierarchy as Q
    from wattline.plans.registry import QUERIES

    for t in ("region", "nation", "orders", "customer"):
        d = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        (d.where("c_nationkey <> 3") if t == "customer" else d).write.parquet(f"{tmp_path}/{t}.parquet")
    root = str(tmp_path)
    f, y = (d.toPandas() for d in Q.forecasts_and_actuals(spark, root, whole=False))
    names = sorted(f["node"].unique())
    at = {n: i for i, n in enumerate(names)}
    leaves = sorted(r["n_name"] for r in spark.read.parquet(f"{root}/nation.parquet").collect())
    s = np.zeros((len(names), len(leaves)))
    for r in Q.H.summation_matrix(Q.E(spark, root)).collect():
        s[at[r["node"]], leaves.index(r["leaf"])] = r["w"]
    wide = f.pivot(index="ts", columns="node", values="yhat").reindex(columns=names)
    res = y.pivot(index="ts", columns="node", values="y").reindex(columns=names) - wide
    var = res.var().clip(lower=1e-10).fillna(1.0).to_numpy()
    assert len(names) == 31 and wide.isna().any(axis=1).all()
    for name, v in (("h14_ols_incomplete", np.ones(31)), ("h15_wls_incomplete", var)):
        got = QUERIES[name](spark, root).toPandas().pivot(index="ts", columns="node", values="yhat").reindex(columns=names)
        assert got.shape == wide.shape
        for day in [*range(9), 40, 400, len(wide) - 1]:
            x = wide.iloc[day].to_numpy()
            seen = ~np.isnan(x)
            part = s[seen] / np.sqrt(v[seen])[:, None]
            want = s @ np.linalg.pinv(part) @ (x[seen] / np.sqrt(v[seen]))
            known = np.abs(s @ np.linalg.pinv(s[seen]) @ s[seen] - s).max(axis=1) < 1e-8
            assert (~np.isnan(got.iloc[day].to_numpy()) == known).all(), (name, day)
            assert np.allclose(got.iloc[day].to_numpy()[known], want[known], rtol=1e-5, atol=1e-2), (name, day)
    assert R.reconcile_ols(spark.createDataFrame([(1, "T", 9.0), (1, "a", 4.0)], "ts int, node string, yhat double"), spark.createDataFrame([("T", "a", 1.0), ("T", "b", 1.0)], "parent string, child string, weight double")).where("node = 'b'").head()["yhat"] == 5.0


def test_contradicting_constraints_raise(spark):
    import pytest

    from wattline.operators.reconcile import enforce_constraints

    S = spark.createDataFrame([("T", "a", 1.0), ("a", "a", 1.0)], "node string, leaf string, w double")
    fc = spark.createDataFrame([(1, "T", 5.0), (1, "a", -2.0)], "ts int, node string, yhat double")
    assert {r["yhat"] for r in enforce_constraints(fc, S).collect()} == {0.0}
    roles = spark.createDataFrame([("a", "losses"), ("T", "generation")], "node string, role string")
    grow = S.where("node = 'a'").union(spark.createDataFrame([("T", "a", 2.0)], "node string, leaf string, w double"))
    with pytest.raises(ValueError, match="not met"):
        enforce_constraints(spark.createDataFrame([(1, "T", 5.0), (1, "a", 3.0)], "ts int, node string, yhat double"), grow, roles)


def test_covariances_equal_numpy(spark):
    """Sample, shrunk and factor covariance on residuals with a common part."""
    import pandas as pd

    rng = np.random.default_rng(5)
    names, n = ["a", "b", "c", "d"], 60
    e = rng.normal(size=(n, 1)) @ np.array([[1.0, 2.0, -1.0, 0.5]]) + rng.normal(size=(n, 4))
    day = pd.Timestamp("2024-01-01")
    res = spark.createDataFrame(pd.DataFrame([(day + pd.Timedelta(days=t), m, float(e[t, i])) for t in range(n) for i, m in enumerate(names)], columns=["ts", "node", "e"]))
    c = np.cov(e.T)
    got, sample = R.residual_cov(res)
    assert got == names and np.allclose(sample, c)
    assert np.allclose(R.residual_cov(res, "diagonal")[1], np.diag(np.diag(c)))
    w, u = np.linalg.eigh(c)
    common = w[-1] * np.outer(u[:, -1], u[:, -1])
    assert np.allclose(R.residual_cov(res, "factor")[1], common + np.diag(np.maximum(np.diag(c - common), 1e-6)))
    x = e - e.mean(axis=0)
    b = x.T @ x / n
    mu = np.trace(b) / 4
    d2 = ((b - mu * np.eye(4)) ** 2).sum() / 4
    b2 = sum(((np.outer(r, r) - b) ** 2).sum() for r in x) / n**2 / 4
    lam = min(b2, d2) / d2
    assert np.allclose(R.residual_cov(res, "ledoit_wolf")[1], (1 - lam) * b + lam * mu * np.eye(4))
    for target in ("identity", "diagonal", "constant_correlation", "factor"):
        _, shrunk, lam = R.shrink_cov(res, target, "holdout")
        assert 0 <= lam <= 1 and np.allclose(np.trace(shrunk), np.trace(c), rtol=0.2)


def test_minimum_error_weights_are_minima(spark):
    """No feasible step lowers the error; two models that are nearly alike don't stall it."""
    rng = np.random.default_rng(7)
    y = rng.normal(100, 10, 300)
    fc = {"p": y + rng.normal(0, 2, 300), "q": y + rng.normal(1, 3, 300)}
    fc["r"] = fc["p"] + rng.normal(0, 0.01, 300)
    rows = [(i, "x", 0, m, float(v[i]), float(y[i])) for m, v in fc.items() for i in range(300)]
    df = spark.createDataFrame(rows, "ts int, area string, horizon int, model string, yhat double, y double")
    w = {r["model"]: r["weight"] for r in C.weights_min_mse(df, list(fc)).collect()}
    mse = lambda w: np.mean((sum(w[m] * fc[m] for m in fc) - y) ** 2)
    assert abs(sum(w.values()) - 1) < 1e-9 and min(w.values()) >= 0
    for a in fc:
        for b in fc:
            step = min(w[a], 1e-3)
            assert mse(w) <= mse(w | {a: w[a] - step, b: w[b] + step}) + 1e-9 if a != b else True


def test_states_on_a_limit_do_not_depend_on_order(spark):
    """0.1 + 0.2 + 0.3 and its permutations have one state."""
    limit = (("good", 0.2),)
    rows = [(a, "m", 1, 100.0, 100.0 - v) for a, p in (("x", (0.1, 0.2, 0.3)), ("y", (0.3, 0.2, 0.1)), ("z", (0.2, 0.3, 0.1))) for v in p]
    df = spark.createDataFrame(rows, "area string, model string, ts int, y double, yhat double").coalesce(1)
    assert {r["state"] for r in C.perf_states(df, limits=limit).collect()} == {"poor"}


def test_error_model_equals_ridge_on_scaled_columns(spark):
    from wattline.operators.intraday import error_model

    rng = np.random.default_rng(2)
    p, d, wt = rng.integers(0, 48, 400), rng.integers(0, 7, 400), rng.uniform(0.1, 1, 400)
    e = 3 + 0.2 * p - 0.5 * d + rng.normal(size=400)
    m = error_model(spark.createDataFrame([(float(a), int(b), int(c), float(w)) for a, b, c, w in zip(e, p, d, wt)], "error double, period int, weekday int, weight double"), alpha=0.0)
    x = np.column_stack([np.ones(400), p, d])
    want = np.linalg.solve(x.T @ (wt[:, None] * x), x.T @ (wt * e))
    assert np.allclose([m.intercept, *m.coefficients.toArray()], want, atol=1e-6)


def test_training_queries_give_no_settings(monkeypatch):
    """Operator defaults (rounds, depth, trees, folds, repeats) and every feature and horizon."""
    import inspect
    from unittest.mock import MagicMock

    from wattline.operators import training as T
    from wattline.plans import q_combine, q_features, q_train
    from wattline.plans.registry import QUERIES

    class Stop(Exception):
        pass

    calls = []

    def stop_at(module, name, go_on=None):
        sig = inspect.signature(getattr(module, name))

        def run(*a, **kw):
            given = sig.bind(*a, **kw).arguments
            calls.append(given)
            for k in ("iters", "depth", "trees", "folds", "repeats", "kw", "settings"):
                if k in given and module is not C:
                    raise AssertionError(f"{name}: {k} is given")
            if go_on is None:
                raise Stop
            return go_on

        monkeypatch.setattr(module, name, run)

    monkeypatch.setattr(q_train, "TR", lambda s, r: MagicMock())
    monkeypatch.setattr(q_features, "training_rows", lambda s, r: MagicMock())
    monkeypatch.setattr(q_combine, "SC", lambda s, r: MagicMock())
    monkeypatch.setattr(q_combine, "stable", lambda d: d)
    monkeypatch.setattr(T, "index_areas", lambda d: MagicMock())
    for n in ("train_gbt", "train_areas", "train_rf", "train_all", "train_pooled", "tune_pooled", "train_job_pooled"):
        stop_at(T, n)
    for n in ("select_rfe", "permutation_importance"):
        stop_at(S, n)
    stop_at(S, "forest_importance", (None, None))
    stop_at(C, "stack_fit")
    for q in ("k02_train_gbt", "k02_train_areas", "k03_predict_gbt", "k03_predict_areas", "k23_train_areas", "k04_train_rf", "k23_train_all", "k24_tune", "k28_train_job", "f04_select_rfe", "f05_permutation_importance", "k05_predict_rf", "m09_stack_fold_scores"):
        with pytest.raises(Stop):
            QUERIES[q](None, "")
        given = calls[-1]
        if q.startswith("m09"):
            assert given["horizons"] == [1, 2, 3]
        elif q != "k05_predict_rf":
            assert set(q_features.COLS) <= set(given["features"]), q


def test_leakage_check_by_hand(spark):
    """Names, counts of usable rows, correlations and both warnings; an empty table gives a row per feature."""
    rows = [(float(i), None if i < 4 else float(i * i), 3.0, 2.0 * i) for i in range(10)]
    df = spark.createDataFrame(rows, "y double, x_lag_24 double, flat double, twice double")
    df = df.withColumn("actual_y", -F.col("y"))
    got = {r["feature"]: r for r in S.leakage_check(df, ["x_lag_24", "flat", "twice", "actual_y"], "y", 2).collect()}
    want = np.corrcoef([i * i for i in range(4, 10)], range(4, 10))[0, 1]
    assert got["x_lag_24"]["reason"] == "lag" and got["x_lag_24"]["n"] == 6 and abs(got["x_lag_24"]["correlation"] - want) < 1e-12
    assert got["flat"]["is_safe"] and got["flat"]["warning"] is None and got["flat"]["correlation"] is None
    assert got["twice"]["is_safe"] and got["twice"]["warning"] == "nearly equals the target"
    assert got["actual_y"]["reason"] == "name" and got["actual_y"]["warning"] == "not known at horizon 2"
    empty = S.leakage_check(df.where("y < 0"), ["flat", "twice"], "y", 2).collect()
    assert [(r["feature"], r["n"], r["warning"]) for r in empty] == [("flat", 0, None), ("twice", 0, None)]


def test_advanced_bias_removes_planted_parts(spark):
    """A trend, a step in the forecast's context and monthly means are found; the cap holds on every row."""
    from wattline.operators import bias as B

    rng = np.random.default_rng(11)
    n = 800
    base, flag = rng.uniform(80, 120, n), rng.integers(0, 2, n)
    month = np.array([5.0, -5, 8, -8, 4, -4, 6, -6, 9, -9, 3, -3])
    day = F.lit("2022-01-01 00:00:00").cast("timestamp_ntz")
    when = np.datetime64("2022-01-01") + np.arange(n)
    e = 0.02 * np.arange(n) + 10.0 * flag + month[when.astype("datetime64[M]").astype(int) % 12] + rng.normal(0, 0.2, n)
    df = spark.createDataFrame([(i, "m", float(b), int(f), float(b + x)) for i, (b, f, x) in enumerate(zip(base, flag, e))], "i int, model string, yhat double, flag int, y double")
    df = df.withColumn("ts", day + F.make_dt_interval(days=F.col("i"))).persist()
    flat = B.bias_advanced(df, B.bias_trend(df))
    full = B.bias_advanced(flat, tree=B.bias_tree(flat, ["flag"], depth=2))
    full = B.bias_advanced(full, times=[B.bias_by_time(full, "monthly")])
    mae = lambda d: d.agg(F.avg(F.abs(F.col("y") - F.col("yhat")))).head()[0]
    assert mae(flat) < 0.8 * mae(df) and mae(full) < 0.2 * mae(df)
    small = B.bias_advanced(df, B.bias_trend(df), tree=B.bias_tree(df, ["flag"]), times=[B.bias_by_time(df, "monthly")], cap=0.01)
    both = small.select("i", F.col("yhat").alias("new")).join(df, "i").select(F.abs(F.col("new") - F.col("yhat")) / F.col("yhat"))
    assert both.agg(F.max(both.columns[0])).head()[0] <= 0.01 + 1e-12


def test_constant_forecasts_have_no_correlation(spark):
    """A flat model among others: its correlations are null, the rest are numpy's, nothing fails."""
    from wattline.operators import diversity as V

    rng = np.random.default_rng(13)
    y = rng.normal(50, 5, 60)
    fc = {"a": y + rng.normal(0, 1, 60), "b": y + rng.normal(0, 3, 60), "flat": np.full(60, 50.1)}
    df = spark.createDataFrame([(i, "x", 1, m, float(v[i]), float(y[i])) for m, v in fc.items() for i in range(60)], "ts int, area string, horizon int, model string, yhat double, y double")
    got = {(r["model_a"], r["model_b"]): r["correlation"] for r in V.pair_diversity(df, list(fc)).collect()}
    assert abs(got["a", "b"] - np.corrcoef(fc["a"], fc["b"])[0, 1]) < 1e-9
    assert got["a", "flat"] is None and got["b", "flat"] is None

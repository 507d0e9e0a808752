"""Ensemble choice against enumeration, minimum-error weights against their certificate."""

from itertools import combinations

import numpy as np
import pytest

from wattline.operators import combine as C
from wattline.operators import ensemble as N


def tables(spark, m, seed):
    r = np.random.default_rng(seed)
    names = [f"m{i:02d}" for i in range(m)]
    mape = r.uniform(1, 12, m)
    half = r.uniform(0, 0.6, (m, m))
    dis = np.triu(half, 1) + np.triu(half, 1).T
    scores = spark.createDataFrame([(n, float(e), float(s)) for n, e, s in zip(names, mape, r.uniform(0, 1, m), strict=True)], "model string, mape double, score double")
    pairs = spark.createDataFrame([(names[i], names[j], float(dis[i, j])) for i in range(m) for j in range(m) if i != j], "model string, other string, dissimilarity double")
    return names, mape, dis, scores, pairs


@pytest.mark.parametrize(("m", "lo", "hi", "w"), [(12, 2, 5, (0.6, 0.3, 0.1)), (12, 1, 12, (0.6, 0.05, 0.1)), (6, 2, 3, (0.2, 0.7, 0.0)), (1, 2, 3, (0.6, 0.3, 0.1))])
def test_best_set_equals_enumeration(spark, m, lo, hi, w):
    names, mape, dis, scores, pairs = tables(spark, m, m + hi)
    top = min(hi, m)

    def value(c):
        d = np.mean([dis[i, j] for i, j in combinations(c, 2)]) if len(c) > 1 else 0.0
        return w[0] / (mape[list(c)].mean() * (0.9 + 0.1 * min(d, 1)) + 1) + w[1] * d - w[2] * len(c) / top

    want = max((c for k in range(min(lo, m), top + 1) for c in combinations(range(m), k)), key=value)
    got = N.best_set(scores, pairs, lo, hi, w).head()
    assert got["members"] == [names[i] for i in want] and got["value"] == pytest.approx(value(want), rel=1e-12)


def test_best_set_of_forty_models(spark):
    names, mape, dis, scores, pairs = tables(spark, 40, 3)
    got = N.best_set(scores, pairs, 2, 4).head()
    own = [names.index(n) for n in got["members"]]
    d = np.mean([dis[i, j] for i, j in combinations(own, 2)])
    assert got["diversity"] == pytest.approx(d) and 2 <= got["size"] <= 4
    three = max(0.6 / (mape[list(c)].mean() * (0.9 + 0.1 * np.mean([dis[p] for p in combinations(c, 2)])) + 1) + 0.3 * np.mean([dis[p] for p in combinations(c, 2)]) - 0.1 * 3 / 4 for c in combinations(range(40), 3))
    assert got["value"] >= three - 1e-12


def test_greedy_set(spark):
    scores = spark.createDataFrame([("a", 4.0, 0.9), ("b", 3.9, 0.8), ("c", 6.0, 0.7), ("d", 2.0, 0.6)], "model string, mape double, score double")
    dis = {("a", "b"): 0.01, ("a", "c"): 0.3, ("a", "d"): 0.4, ("b", "c"): 0.3, ("b", "d"): 0.3, ("c", "d"): 0.2}
    pairs = spark.createDataFrame([(*p, v) for (x, y), v in dis.items() for p in ((x, y), (y, x))], "model string, other string, dissimilarity double")
    got = N.greedy_set(scores, pairs).head()  # b is redundant, c raises the error
    assert got["members"] == ["a", "d"] and got["mape"] == pytest.approx(3.0 * 0.94) and got["diversity"] == pytest.approx(0.4)
    assert N.greedy_set(scores, pairs, lo=3, gain=9.0).head()["members"] == ["a", "b", "c"]


def test_lowest_mix():
    r = np.random.default_rng(1)
    for _ in range(50):
        cuts = r.standard_normal((r.integers(1, 12), r.integers(1, 6))) * 10.0 ** r.integers(-3, 4)
        w, v = C.lowest_mix(cuts)
        assert w.min() >= 0 and w.sum() == pytest.approx(1)
        some = r.dirichlet(np.ones(cuts.shape[1]) * 0.5, 4000)
        assert v <= (some @ cuts.T).max(axis=1).min() + 1e-9 * np.abs(cuts).max()


def test_min_mae_of_ten_models(spark):
    """Error and lower bound meet; no other weights are better."""
    r = np.random.default_rng(4)
    models = [f"m{i}" for i in range(10)]
    y = r.normal(100, 10, 400)
    x = y[:, None] + r.normal(0, 1, (400, 10)) * np.linspace(1, 4, 10) + r.normal(0, 1, 10)
    rows = [(t, "z", 1, m, float(x[t, i]), float(y[t])) for t in range(400) for i, m in enumerate(models)]
    df = spark.createDataFrame(rows, "ts int, area string, horizon int, model string, yhat double, y double")
    weights, proof = C.min_mae_rounds(df, models)
    w = np.array([row["weight"] for row in weights.collect()])
    p = proof.head()
    mae = np.abs(x @ w - y).mean()
    assert w.min() >= 0 and w.sum() == pytest.approx(1) and p["mae"] == pytest.approx(mae) and mae - p["bound"] <= 1e-6 * mae
    near = np.clip(w + r.normal(0, 0.02, (5000, 10)), 0, None)
    near /= near.sum(axis=1, keepdims=True)
    assert np.abs(near @ x.T - y).mean(axis=1).min() >= p["bound"]

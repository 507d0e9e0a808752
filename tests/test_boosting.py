"""Boosted trees of all groups at once against a plain loop over one group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.operators import boosting as B

FEATURES = ["a", "b", "c"]


def bins_of(v, cuts):
    return 0 if v is None or np.isnan(v) else 1 + int(np.sum(np.array(cuts) < v))


def plain(bins, y, train, rounds, depth, rate=0.1, l2=1.0, least=20):
    """Every split by trying all features and bins; no sums are shared."""
    pred, splits = np.full(len(y), y[train].mean()), []
    for t in range(rounds):
        node, value = np.zeros(len(y), int), np.zeros(len(y))
        r = y - pred
        value[:] = rate * r[train].sum() / (train.sum() + l2)
        for level in range(depth):
            for m in range(2**level - 1, 2 ** (level + 1) - 1):
                here = node == m
                own = here & train
                if not own.any():
                    continue
                best = None
                for f in range(bins.shape[1]):
                    for b in range(bins[:, f].max() + 1):
                        left = own & (bins[:, f] <= b)
                        nl, nr = left.sum(), own.sum() - left.sum()
                        if min(nl, nr) < least:
                            continue
                        gl, g = r[left].sum(), r[own].sum()
                        gain = gl**2 / (nl + l2) + (g - gl) ** 2 / (nr + l2) - g**2 / (nl + nr + l2)
                        if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-12)):
                            best = (gain, f, b, rate * gl / (nl + l2), rate * (g - gl) / (nr + l2))
                if best:
                    splits.append((t, m, best[1], best[2]))
                    right = here & (bins[:, best[1]] > best[2])
                    value[here] = np.where(right, best[4], best[3])[here]
                    node[here] = (2 * m + 1 + right)[here]
        pred = pred + value
    return pred, splits


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(0)
    rows = []
    for area, n, slope in (("x", 300, 3.0), ("y", 160, -2.0), ("z", 30, 1.0)):
        for i in range(n):
            a, b, c = float(r.integers(0, 12)), float(r.standard_normal()), float(r.standard_normal())
            rows.append((area, i, a, None if i % 17 == 0 else b, float("nan") if i % 19 == 0 else c, slope * a + (2.0 if b > 0 else 0.0) + 0.1 * float(r.standard_normal()), min(i * 4 // n, 3)))
    return spark.createDataFrame(rows, "area string, ts int, a double, b double, c double, y double, fold int"), rows


def test_every_group_and_run_equals_a_plain_fit(data):
    df, rows = data
    runs = {"all": {"rounds": 3, "depth": 3}, "late": {"rounds": 2, "depth": 2, "rate": 0.3, "l2": 0.0, "min_rows": 5, "train_before": 3}}
    m = B.boost(df, FEATURES, "y", runs=runs, fold="fold", bins=16)
    cuts = {r["area"]: r["cuts"] for r in m.cuts.collect()}
    fitted = {(r["area"], r["run"], r["ts"]): r["yhat"] for r in m.fitted.collect()}
    trees = m.trees.where("feature is not null").collect()
    for area in cuts:
        own = [x for x in rows if x[0] == area]
        bins = np.array([[bins_of(x[2 + f], cuts[area][f]) for f in range(3)] for x in own])
        y, fold = np.array([x[5] for x in own]), np.array([x[6] for x in own])
        for run, p in runs.items():
            train = fold < p.get("train_before", 9)
            pred, splits = plain(bins, y, train, p["rounds"], p["depth"], p.get("rate", 0.1), p.get("l2", 1.0), p.get("min_rows", 20))
            got = sorted((t["tree"], t["node"], t["feature"], t["bin"]) for t in trees if t["area"] == area and t["run"] == run)
            assert got == sorted(splits)
            assert bool(splits) == (area != "z" or run == "late")
            for x, want in zip(own, pred, strict=True):
                assert fitted[area, run, x[1]] == pytest.approx(want, rel=1e-9)


def test_new_rows_are_scored_like_training_rows(data):
    df, _ = data
    m = B.boost(df, FEATURES, "y", runs={"all": {"rounds": 4, "depth": 3}})
    got = {(r["area"], r["ts"]): r["yhat"] for r in B.predict(m, df).collect()}
    want = {(r["area"], r["ts"]): r["yhat"] for r in m.fitted.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)


def test_folds_and_importance(data):
    df, rows = data
    m = B.boost(df, FEATURES, "y", runs=B.fold_runs(3, rounds=4, depth=2), fold="fold")
    score = {(r["area"], r["run"]): (r["n"], r["mae"]) for r in B.fold_errors(m).collect()}
    assert {k[1] for k in score} == {"fold1", "fold2", "fold3"}
    for area in "xyz":
        assert [score[area, f"fold{k}"][0] for k in (1, 2, 3)] == [sum(x[0] == area and x[6] == k for x in rows) for k in (1, 2, 3)]
    share = {(r["area"], r["feature"]): r["importance"] for r in B.importance(m).collect()}
    assert share["x", "a"] > 0.9 and sum(share["x", f] for f in FEATURES) == pytest.approx(1)
    assert [share["z", f] for f in FEATURES] == [0.0, 0.0, 0.0] or sum(share["z", f] for f in FEATURES) == pytest.approx(1)


def test_null_targets_teach_nothing(data):
    df, _ = data
    some = df.withColumn("y", F.when(F.col("ts") % 2 == 0, F.col("y")))
    m = B.boost(some, FEATURES, "y", runs={"all": {"rounds": 1, "depth": 1}})
    assert m.fitted.count() == df.where("ts % 2 = 0").count()

"""Smoothing by composed blocks against a plain loop over the series."""

from datetime import date

import numpy as np
import pytest

from wattline.operators import smoothing as H


def plain(x, season, mul):
    """Best (sse, grid point, level, trend, season) of a loop over all values."""
    best = None
    for g in H.GRID:
        a, b, c = g
        level = np.mean(x[:season])
        trend = (np.mean(x[season:2 * season]) - level) / season
        s = [v / level if mul else v - level for v in x[:season]]
        sse = 0.0
        for i, v in enumerate(x[season:]):
            k = i % season
            sse += (v - ((level + trend) * s[k] if mul else level + trend + s[k])) ** 2
            new = a * (v / s[k] if mul else v - s[k]) + (1 - a) * (level + trend)
            trend = b * (new - level) + (1 - b) * trend
            s[k] = c * (v / new if mul else v - new) + (1 - c) * s[k]
            level = new
        if best is None or (sse, g) < best[:2]:
            best = (sse, g, level, trend, s)
    return best


@pytest.mark.parametrize(("rows", "fan"), [(512, 64), (16, 3), (1, 2)])
def test_blocks_equal_a_loop(spark, monkeypatch, rows, fan):
    monkeypatch.setattr(H, "FAN_IN", fan)
    r = np.random.default_rng(rows)
    wave = np.array([0, 5, 10, 3, -4, -8, -6])
    series = {
        "long": 100 + 0.3 * np.arange(120) + wave[np.arange(120) % 7] + r.normal(0, 2, 120), "short": r.normal(10, 1, 14), "below": r.normal(0, 5, 40),
        "steep": 50 * np.exp(0.01 * np.arange(60)) * (1 + 0.02 * wave[np.arange(60) % 7]), "tiny": r.normal(5, 1, 13), "flat": np.full(30, 7.0),
    }
    rows_of = [(k, i, None if k == "long" and i == 50 else float(v)) for k, x in series.items() for i, v in enumerate(x)]
    r.shuffle(rows_of)
    df = spark.createDataFrame([(str(a), int(b), None if c is None else float(c)) for a, b, c in rows_of], "area string, i int, load double")
    df = df.selectExpr("area", "date_add(date'2020-01-01', i) as ts", "load").repartition(3)
    for mul in (False, True):
        got = {x["area"]: x for x in H.holt_winters(df, ["area"], allow_multiplicative=mul, rows=rows).collect()}
        assert set(got) == set(series) - {"tiny"}
        for k, x in series.items():
            if k == "tiny":
                continue
            x = np.delete(x, 50) if k == "long" else x
            m = mul and x.min() > 0
            sse, grid, level, trend, season = plain(x, 7, m)
            g = got[k]
            assert g["multiplicative"] == m and g["n"] == len(x) and g["steps"] == len(x) - 7 and (g["origin"] - date(2020, 1, 1)).days == len(series[k]) - 1
            assert g["sse"] == pytest.approx(sse, rel=1e-7, abs=1e-7)
            if k != "flat":  # every grid point fits it
                assert (g["alpha"], g["beta"], g["gamma"]) == grid
            assert g["level"] == pytest.approx(level, rel=1e-7) and g["trend"] == pytest.approx(trend, rel=1e-6, abs=1e-8) and np.allclose(g["season"], season, rtol=1e-6, atol=1e-8)

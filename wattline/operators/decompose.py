"""Smoothing, wavelets and seasonal decomposition."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.ordered import BLOCK_ROWS, bounded, positions, quantiles, seconds, stable

BY = ("area",)
YEARLY = {"yearly": (365.25, 3)}  # days, waves
EPOCH_DAYS = 10_000  # origin of the trend, which keeps its numbers small

# Orthonormal low-pass taps; the high-pass is the quadrature mirror.
TAPS = {
    "haar": [0.7071067811865476, 0.7071067811865476],
    "db2": [0.48296291314453416, 0.8365163037378079, 0.2241438680420134, -0.12940952255126037],
    "db4": [0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385,
            -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278],
}


# --- LOESS ----------------------------------------------------------------------
MOMENT_ROWS = 512  # neighbours from which on sums come from prefix moments


def _windows(x, r, n: int, k: int):
    """First row numbers of the k nearest rows of each row in ``r`` (positions in ``x``)."""
    return np.clip(x[r] - k // 2, 1, n - k + 1) if n >= k else np.ones(len(r), dtype=int)


def _estimate(a: np.ndarray, b: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Values at distance 0 of weighted least squares with normal equations a, b; weighted mean where they are singular."""
    ok = np.abs(np.linalg.det(a)) > 1e-12 * np.maximum(np.abs(np.diagonal(a, axis1=1, axis2=2)).prod(axis=1), 1e-300)
    weight = a[:, 0, 0]
    est = np.where(weight > 0, b[:, 0] / np.where(weight > 0, weight, 1), plain)
    if ok.any():
        est[ok] = np.linalg.solve(a[ok], b[ok][:, :, None])[:, 0, 0]
    return est


def _fit_direct(x, y, robust, r, n: int, k: int, degree: int) -> np.ndarray:
    """Local fits that look at all neighbours of every row."""
    out = np.empty(len(r))
    step = max(1, 2_000_000 // k)
    for s in range(0, len(r), step):
        own = r[s:s + step]
        idx = (_windows(x, own, n, k) - x[0])[:, None] + np.arange(min(k, n))[None, :]
        d = (x[idx] - x[own][:, None]).astype(float)
        far = np.abs(d).max(axis=1, keepdims=True)
        far[far == 0] = 1.0
        d /= far
        w = (1 - np.abs(d) ** 3) ** 3 * robust[idx]
        powers = np.stack([d ** p for p in range(degree + 1)], axis=2)
        a = np.einsum("rk,rkp,rkq->rpq", w, powers, powers)
        b = np.einsum("rk,rkp->rp", w, powers * y[idx][:, :, None])
        out[s:s + step] = _estimate(a, b, y[idx].mean(axis=1))
    return out


def _fit_moments(x, y, robust, r, n: int, k: int, degree: int) -> np.ndarray:
    """The same fits in time linear in the rows.

    A tricube weight is a polynomial of degree 9 in the distance on either side, so every sum of a
    fit is made of sums of powers over the rows to the left and to the right. Those are differences of
    prefix sums of powers, centred on a run of k/8 rows and moved to each of its rows by the
    binomial rule; the move is short against the window, which keeps the digits.
    """
    top, out = 9 + 2 * degree, np.empty(len(r))
    pascal = [[comb(p, q) for q in range(p + 1)] for p in range(top + 1)]
    first = _windows(x, r, n, k) - x[0]
    last = first + min(k, n) - 1
    step = max(1, k // 8)
    for s in range(0, len(r), step):
        at, lo, hi = r[s:s + step], first[s:s + step], last[s:s + step]
        start, end = lo.min(), hi.max()
        center = (x[at[0]] + x[at[-1]]) / 2
        size = float(max(center - x[start], x[end] - center, 1.0))
        u = (x[start:end + 1] - center) / size
        v = np.power.outer(u, np.arange(top + 1)).T
        rw, ry = robust[start:end + 1], robust[start:end + 1] * y[start:end + 1]
        sums = np.zeros((2, top + 1, len(u) + 1))
        np.cumsum(rw * v, axis=1, out=sums[0, :, 1:])
        np.cumsum(ry * v, axis=1, out=sums[1, :, 1:])
        mid = at - start + 1  # the row itself is on the left
        sides = [sums[:, :, mid] - sums[:, :, lo - start], sums[:, :, hi - start + 1] - sums[:, :, mid]]
        shift = np.power.outer(-(x[at] - center) / size, np.arange(top + 1)).T
        moved = [np.stack([sum(pascal[p][q] * shift[p - q] * m[:, q] for q in range(p + 1)) for p in range(top + 1)], axis=1) for m in sides]
        far = np.maximum(x[at] - x[lo], x[hi] - x[at]).astype(float) / size
        far[far == 0] = 1.0

        def total(kind: int, p: int) -> np.ndarray:  # sum of weight * distance^p (* y), distances as shares of the largest
            return sum(c * ((-1) ** m * moved[0][kind, 3 * m + p] + moved[1][kind, 3 * m + p]) / far ** (3 * m + p) for m, c in enumerate((1, -3, 3, -1)))

        a = np.stack([np.stack([total(0, p + q) for q in range(degree + 1)], axis=1) for p in range(degree + 1)], axis=1)
        b = np.stack([total(1, p) for p in range(degree + 1)], axis=1)
        ones = np.concatenate([[0.0], np.cumsum(y[start:end + 1])])
        out[s:s + step] = _estimate(a, b, (ones[hi - start + 1] - ones[lo - start]) / (hi - lo + 1))
    return out


def _fit_block(x, y, robust, own, n: int, k: int, degree: int) -> np.ndarray:
    """Local fits for the rows ``own`` of a block; ``x`` are consecutive row numbers."""
    fit = _fit_moments if k >= MOMENT_ROWS else _fit_direct
    return fit(x, y, robust, np.flatnonzero(own), n, k, degree)


def _loess_pass(p: DataFrame, by: Sequence[str], frac: float, degree: int) -> DataFrame:
    k = F.greatest(F.lit(3), F.ceil(F.lit(frac) * F.col("__n"))).cast("long")
    width = F.greatest(F.lit(BLOCK_ROWS), F.col("__k"))
    src = p.withColumn("__k", k)
    own = F.floor((F.col("__i") - 1) / width)
    off = (F.col("__i") - 1) - own * width
    near = F.array_compact(F.array(own, F.when(off >= width - F.col("__k"), own + 1), F.when(off < F.col("__k"), own - 1)))
    src = src.withColumn("__o", own).withColumn("__b", F.explode(near)).withColumn("__own", F.col("__o") == F.col("__b"))
    keys = [*by, "__b"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        o = pdf["__own"].to_numpy(bool)
        if not o.any():
            return pdf.loc[o, [*by, "__i"]].assign(__s=np.empty(0))
        x = pdf["__i"].to_numpy(np.int64)
        s = _fit_block(x, pdf["__y"].to_numpy(float), pdf["__w"].to_numpy(float), o, int(pdf["__n"].iloc[0]), int(pdf["__k"].iloc[0]), degree)
        return pdf.loc[o, [*by, "__i"]].assign(__s=s)

    schema = ", ".join(f"`{c}` {dict(p.dtypes)[c]}" for c in by) + ", __i bigint, __s double"
    fitted = src.select(*keys, "__i", "__y", "__w", "__n", "__k", "__own").groupBy(*keys).applyInPandas(fit, schema)
    return p.join(fitted, [*by, "__i"])


def loess(df: DataFrame, c: str = "load", frac: float = 0.1, degree: int = 1, iterations: int = 3,
          by: Sequence[str] = BY, t: str = "ts") -> DataFrame:
    """Local regression over the k nearest rows. A block of rows with its neighbours is one
    task, with work linear in its rows for wide windows; missing rows enter a fit as 0 and get no smoothed value, as in the source system."""
    by = list(by)
    p = positions(df, by, t, name="__i", total="__n").withColumns({
        "__i": F.col("__i").cast("long"), "__y": F.coalesce(F.col(c).cast("double"), F.lit(0.0)), "__w": F.lit(1.0),
    })
    for it in range(iterations):
        p = _loess_pass(p, by, frac, degree)
        if it == iterations - 1:
            break
        p = stable(p.withColumn("__r", F.when(F.col(c).isNotNull(), F.abs(F.col("__y") - F.col("__s")))))
        mad = quantiles(p, by, "__r", {"__mad": 0.5})
        u = F.least(F.col("__r") / (6 * F.col("__mad")), F.lit(1.0))
        robust = F.when(F.col("__r").isNull() | (F.col("__mad") == 0), 1.0).otherwise(F.pow(1 - u * u, F.lit(2)))
        p = p.join(mad, by).withColumn("__w", robust).drop("__r", "__s", "__mad")
    smooth = F.when(F.col(c).isNotNull(), F.col("__s"))
    return p.withColumns({f"{c}_smooth": smooth, f"{c}_residual": F.col(c) - smooth}).drop("__i", "__n", "__y", "__w", "__s")


# --- wavelets -------------------------------------------------------------------
def _scatter(low: list[float], index, terms: Mapping[str, tuple[str, str]]):
    """Rows of contributions: one struct per tap with the target index and the products."""
    size = len(low)
    high = [(-1) ** j * low[size - 1 - j] for j in range(size)]
    cells = []
    for j in range(size):
        vals = [(F.col(src) * (low if band == "low" else high)[j]).alias(out) for out, (src, band) in terms.items()]
        cells.append(F.struct(index(j).alias("k"), *vals))
    return cells


def wavelet(df: DataFrame, c: str = "load", wavelet: str = "db4", level: int = 3, by: Sequence[str] = BY, t: str = "ts") -> DataFrame:
    """Periodic transform; ``approx`` and ``detail_1..level`` are signals of full length that
    add up to the input. Every level is one scatter of products and one grouped sum."""
    if wavelet not in TAPS or not 1 <= level <= 8:
        raise ValueError("wavelet must be haar, db2 or db4 and level 1..8")
    by, low = list(by), TAPS[wavelet]
    p = positions(df, by, t, name="__i", total="__n").withColumn("__i", F.col("__i").cast("long") - 1)
    cur = p.select(*by, F.col("__i").alias("k"), F.col("__n").alias("n0"), F.col(c).cast("double").alias("a"))
    details = []
    for lv in range(1, level + 1):
        n = f"n{lv - 1}"
        even = F.col(n) + F.col(n) % 2
        # an odd level is extended by its last value
        own = F.array_compact(F.array(F.col("k"), F.when((F.col(n) % 2 == 1) & (F.col("k") == F.col(n) - 1), F.col(n))))
        ext = cur.withColumn("m", even).withColumn("k", F.explode(own))
        target = lambda j: F.when((F.col("k") - j) % 2 == 0, F.pmod(F.col("k") - j, F.col("m")) / 2).cast("long")
        cells = _scatter(low, target, {"a": ("a", "low"), "d": ("a", "high")})
        sizes = [f"n{i}" for i in range(lv)]
        out = ext.select(*by, *sizes, (F.col("m") / 2).cast("long").alias(f"n{lv}"), F.explode(F.array(*cells)).alias("x"))
        g = out.where("x.k is not null").groupBy(*by, *sizes, f"n{lv}", "x.k").agg(F.sum("x.a").alias("a"), F.sum("x.d").alias("d"))
        if level > 3:
            g = stable(g)
        details.append(g.select(*by, *sizes, f"n{lv}", "k", "d"))
        cur = g.drop("d")
    comps, back = ["a"], cur
    for lv in range(level, 0, -1):
        d = details[lv - 1].select(*by, "k", F.col("d").alias(f"d{lv}"))
        back = back.join(d, [*by, "k"])
        terms = {x: (x, "low") for x in comps} | {f"d{lv}": (f"d{lv}", "high")}
        comps = [*comps, f"d{lv}"]
        sizes = [f"n{i}" for i in range(lv)]
        cells = _scatter(low, lambda j, lv=lv: F.pmod(2 * F.col("k") + j, 2 * F.col(f"n{lv}")), terms)
        out = back.select(*by, *sizes, F.explode(F.array(*cells)).alias("x")).where(F.col("x.k") < F.col(f"n{lv - 1}"))
        back = out.groupBy(*by, *sizes, "x.k").agg(*[F.sum(f"x.{x}").alias(x) for x in comps])
    names = {"a": "approx"} | {f"d{i}": f"detail_{i}" for i in range(1, level + 1)}
    res = back.select(*by, F.col("k").alias("__i"), *[F.col(x).alias(f"{c}_{names[x]}") for x in comps])
    return p.join(res, [*by, "__i"]).drop("__i", "__n")


# --- seasonal decomposition -----------------------------------------------------
def _trend(df: DataFrame, c: str, period: int, by: Sequence[str], t: str, step: int | None) -> DataFrame:
    half = period // 2

    def make(w):
        fr = w.rowsBetween(-half, half)
        s, n = F.sum(c).over(fr), F.count(c).over(fr)
        if period % 2 == 0:  # the two end points count half
            for e in (F.lag(c, half).over(w), F.lead(c, half).over(w)):
                s = s - F.coalesce(e, F.lit(0.0)) / 2
                n = n - F.when(e.isNotNull(), 0.5).otherwise(0.0)
        return {"trend": s / n}

    return bounded(df, by, t, make, back=half, ahead=half, step=step)


def decompose(df: DataFrame, c: str = "load", period: int = 48, by: Sequence[str] = BY, t: str = "ts", robust: bool = False,
              name: str = "seasonal", step: int | None = None) -> DataFrame:
    """trend (centred moving average), phase mean (or median) as season, residual."""
    by = list(by)
    x = positions(_trend(df, c, period, by, t, step), by, t, name="__rn")
    x = x.withColumns({"__ph": (F.col("__rn") - 1) % period, "__d": F.col(c) - F.col("trend")})
    if robust:
        ph = quantiles(x, [*by, "__ph"], "__d", {"__s": 0.5})
    else:
        ph = x.groupBy(*by, "__ph").agg(F.avg("__d").alias("__s"))
    ph = ph.join(ph.groupBy(*by).agg(F.avg("__s").alias("__c")), by)
    ph = ph.select(*by, "__ph", (F.col("__s") - F.col("__c")).alias(name))
    out = x.join(ph, [*by, "__ph"], "left")
    return out.withColumn("residual", F.col(c) - F.col("trend") - F.col(name)).drop("__rn", "__ph", "__d")


def harmonic_season(df: DataFrame, c: str, days: float, k: int, by: Sequence[str] = BY, t: str = "ts", name: str = "seasonal", ridge: float = 0.0) -> DataFrame:
    """Season of a period of ``days`` that a series may hold only once or twice: ``k`` harmonics, fitted together with
    a level and a straight trend, so that the season takes nothing of either.

    The normal equations are sums per group, one aggregate; no phase needs a second sight of the
    period. The season is centred on its mean over the series. A group that spans less than one period has none (0).
    """
    from wattline.operators.profiles import least_squares

    by = list(by)
    at = seconds(t) / 86400.0
    waves = {f"__{f}{j}": (F.cos if f == "c" else F.sin)(2 * math.pi * j / days * at) for j in range(1, k + 1) for f in "cs"}
    x = df.withColumns({**waves, "__slope": (at - EPOCH_DAYS) / days})
    names = [*waves, "__slope"]
    coef = least_squares(x, by, names, c, ridge).select(*by, "coef")
    spans = x.where(F.col(c).isNotNull()).groupBy(*by).agg((F.max("__slope") - F.min("__slope")).alias("__span"), *[F.avg(w).alias(f"{w}m") for w in waves])
    season = sum((F.get("coef", F.lit(i + 1)) * (F.col(w) - F.col(f"{w}m")) for i, w in enumerate(waves)), F.lit(0.0))
    fitted = x.join(coef.join(spans, by), by, "left").withColumn(name, F.when(F.col("__span") >= 1, season).otherwise(F.lit(0.0)))
    return fitted.drop(*names, *[f"{w}m" for w in waves], "coef", "__span")


def decompose_multi(df: DataFrame, c: str = "load", periods: Mapping[str, int] | None = None, by: Sequence[str] = BY,
                    t: str = "ts", step: int | None = None, harmonics: Mapping[str, tuple[float, int]] | None = None) -> DataFrame:
    """Shortest period first, the next one from what is left.

    ``periods`` (rows) are seasons of phase means, which need many periods; ``harmonics`` (days, number of
    waves) are seasons by regression, taken out first: a yearly one by default, where a series spans a year.
    """
    periods = periods or {"daily": 48, "weekly": 336}
    out = df.withColumn("__x", F.col(c))
    for name, (days, k) in (YEARLY if harmonics is None else harmonics).items():
        out = harmonic_season(out, "__x", days, k, by, t, f"seasonal_{name}")
        out = out.withColumn("__x", F.col("__x") - F.col(f"seasonal_{name}"))
    for name, p in sorted(periods.items(), key=lambda kv: kv[1]):
        out = out.drop("trend", "residual")
        out = decompose(out, "__x", p, by, t, name=f"seasonal_{name}", step=step)
        out = out.withColumn("__x", F.col("__x") - F.col(f"seasonal_{name}"))
    return out.withColumn("residual", F.col("__x") - F.col("trend")).drop("__x")


def component_features(df: DataFrame, periods: Mapping[str, int], by: Sequence[str] = BY, t: str = "ts", step: int | None = None) -> DataFrame:
    names = [f"seasonal_{n}" for n in periods]

    def make(w):
        out = {}
        for n, p in periods.items():
            s = f"seasonal_{n}"
            out[f"{s}_lag_1"] = F.lag(s, 1).over(w)
            out[f"{s}_diff"] = F.col(s) - F.lag(s, p).over(w)
        return out

    x = bounded(df, by, t, make, back=max(periods.values()), step=step)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return x.withColumns({"detrended": total + F.col("residual"), "deseasonalized": F.col("trend") + F.col("residual")})


def seasonal_profile(df: DataFrame, c: str, period: int, by: Sequence[str] = BY, t: str = "ts") -> DataFrame:
    """Mean by phase over the complete cycles."""
    p = positions(df, by, t, name="__rn", total="__n")
    full = p.where(F.col("__rn") <= F.floor(F.col("__n") / period) * period)
    return full.groupBy(*by, ((F.col("__rn") - 1) % period).cast("long").alias("phase")).agg(F.avg(c).alias("profile"))


def strength(df: DataFrame, components: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """max(0, 1 - var(residual) / var(component + residual)) per component, with its class."""
    a = df.groupBy(*by).agg(
        F.var_samp("residual").alias("__r"), *[F.var_samp(F.col(c) + F.col("residual")).alias(c) for c in components]
    )
    long = a.unpivot([*by, "__r"], list(components), "component", "__v")
    s = F.when(F.col("__v") > 0, F.greatest(F.lit(0.0), 1 - F.col("__r") / F.col("__v"))).otherwise(0.0)
    label = F.when(F.col("strength") > 0.6, "strong").when(F.col("strength") > 0.3, "moderate").otherwise("weak")
    return long.select(*by, "component", s.alias("strength")).withColumn("class", label)

"""Trend and season smoothing (Holt-Winters) without a series in one array.

With an additive season one step is an affine map of the state (level, trend, seasonal values as a shift
register), and the squared errors of a run of steps are a quadratic form of the state it starts from. Both are
kept for a block of rows, without knowing that state; blocks are then composed, a fixed number
at a time, in as many rounds as it takes to have one block per series. The start values close it.

A multiplicative season divides by the state, so blocks can't be summarised ahead: the state is
handed on from block to block, for all series at once. Every grid point of the smoothing weights is carried along.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from wattline.functions.ordered import positions, stable

GRID = tuple((a, b, g) for a in (0.1, 0.3, 0.6) for b in (0.01, 0.1) for g in (0.05, 0.2, 0.4))
ROWS = 512  # rows of a block
FAN_IN = 64  # blocks that are composed at a time


@lru_cache(maxsize=4)
def _maps(season: int, rows: int) -> tuple[np.ndarray, ...]:
    """For every grid point: the gain of a value, powers of the step, forecast rows h_j, and sums of h_j h_j' up to j."""
    d = season + 2
    step, gain = np.zeros((len(GRID), d, d)), np.zeros((len(GRID), d))
    for i, (a, b, g) in enumerate(GRID):
        step[i, 0, :3] = 1 - a, 1 - a, -a
        step[i, 1, :3] = -a * b, 1 - a * b, -a * b
        for j in range(2, d - 1):
            step[i, j, j + 1] = 1.0
        step[i, d - 1, :3] = -g * (1 - a), -g * (1 - a), g * a + 1 - g
        gain[i, 0], gain[i, 1], gain[i, d - 1] = a, a * b, g * (1 - a)
    look = np.zeros(d)
    look[:3] = 1.0
    powers = np.zeros((rows + 1, len(GRID), d, d))
    powers[0] = np.eye(d)
    for j in range(rows):
        powers[j + 1] = step @ powers[j]
    h = look @ powers[:rows]
    quad = np.concatenate([np.zeros((1, len(GRID), d, d)), np.cumsum(h[:, :, :, None] * h[:, :, None, :], axis=0)])
    return gain, step, powers, h, quad


def summarise(blocks: list[np.ndarray], season: int, rows: int) -> list[np.ndarray]:
    """(map, offset, errors) of every block, one row per grid point: the state after it is
    map @ z + offset, its squared errors are e0 - 2 e1 @ z + z @ E @ z."""
    gain, step, powers, h, quad = _maps(season, rows)
    d = season + 2
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    size = np.array([len(blocks[i]) for i in order])
    x = np.zeros((len(blocks), size.max(initial=0)))
    for k, i in enumerate(order):
        x[k, :len(blocks[i])] = blocks[i]
    z, e0, e1 = np.zeros((len(blocks), len(GRID), d)), np.zeros((len(blocks), len(GRID))), np.zeros((len(blocks), len(GRID), d))
    for j in range(x.shape[1]):
        live = int((size > j).sum())
        v = x[:live, j, None]
        r = v - z[:live, :, :3].sum(axis=2)
        e0[:live] += r * r
        e1[:live] += r[:, :, None] * h[j]
        z[:live] = np.einsum("gij,kgj->kgi", step, z[:live]) + v[:, :, None] * gain
    out: list[np.ndarray] = [np.zeros(0)] * len(blocks)
    for k, i in enumerate(order):
        m = size[k]
        out[i] = np.concatenate([powers[m].reshape(len(GRID), -1), z[k], e0[k][:, None], e1[k], quad[m].reshape(len(GRID), -1)], axis=1)
    return out


def compose(parts: Sequence[np.ndarray], season: int) -> np.ndarray:
    """The summary of consecutive blocks from theirs."""
    d = season + 2
    cut = np.cumsum([d * d, d, 1, d])

    def split(s):
        a, z, e0, e1, q = np.split(s, cut, axis=1)
        return a.reshape(-1, d, d), z, e0[:, 0], e1, q.reshape(-1, d, d)

    a, z, e0, e1, q = split(parts[0])
    for s in parts[1:]:
        a2, z2, f0, f1, p = split(s)
        pz = np.einsum("gij,gj->gi", p, z)
        e0 = e0 + f0 - 2 * (f1 * z).sum(axis=1) + (z * pz).sum(axis=1)
        e1 = e1 + np.einsum("gji,gj->gi", a, f1 - pz)
        q = q + np.einsum("gji,gjk,gkl->gil", a, p, a)
        z = np.einsum("gij,gj->gi", a2, z) + z2
        a = a2 @ a
    return np.concatenate([a.reshape(len(GRID), -1), z, e0[:, None], e1, q.reshape(len(GRID), -1)], axis=1)


def _finish(total: np.ndarray | None, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State and squared errors of every grid point after all blocks."""
    d = len(start)
    if total is None:
        return np.tile(start, (len(GRID), 1)), np.zeros(len(GRID))
    a, z, e0, e1, q = np.split(total, np.cumsum([d * d, d, 1, d]), axis=1)
    state = (a.reshape(-1, d, d) @ start) + z
    return state, np.maximum(e0[:, 0] - 2 * e1 @ start + np.einsum("i,gij,j->g", start, q.reshape(-1, d, d), start), 0.0)


def multiplicative_steps(state: np.ndarray, sse: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One block of values for every grid point, from the state before it."""
    a, b, g = np.array(GRID).T
    z = state.copy()
    for v in x:
        level, trend, s = z[:, 0].copy(), z[:, 1].copy(), z[:, 2].copy()
        line = level + trend
        sse = sse + (v - line * s) ** 2
        z[:, 0] = a * v / s + (1 - a) * line
        z[:, 1] = b * (z[:, 0] - level) + (1 - b) * trend
        z[:, 2:-1] = z[:, 3:]
        z[:, -1] = g * v / z[:, 0] + (1 - g) * s
    return z, sse


def holt_winters(df: DataFrame, by: Sequence[str], t: str = "ts", c: str = "load", season: int = 7, allow_multiplicative: bool = False, rows: int | None = None) -> DataFrame:
    """Level, trend and season after the last value of every series of two seasons or more, at the
    grid point with the least squared error (the first one of equals).

    With ``allow_multiplicative`` a series of positive values uses a multiplicative season.
    """
    by, rows = list(by), rows or ROWS
    x = F.col(c).cast("double")
    numbered = isinstance(df.schema[t].dataType, NumericType)  # else a date or a time
    p = positions(df.where(x.isNotNull()), by, t, name="__rn", total="__n", block=F.floor(F.col(t) / rows) if numbered else None).where(F.col("__n") >= 2 * season)
    p = stable(p.select(*by, F.col(t).alias("__t"), x.alias("__v"), F.col("__rn").cast("long").alias("__rn"), F.col("__n").cast("long").alias("__n")))
    head = F.when(F.col("__rn") <= 2 * season, F.struct("__rn", "__v"))
    start = p.groupBy(*by).agg(
        F.array_sort(F.collect_list(head)).getField("__v").alias("__head"), F.max("__t").alias("origin"), F.max("__n").alias("n"),
        (F.lit(allow_multiplicative) & (F.min("__v") > 0)).alias("multiplicative"))  # at most two seasons of values
    start = stable(start)
    cut = p.where(F.col("__rn") > season).withColumn("__b", F.floor((F.col("__rn") - season - 1) / rows).cast("long"))
    cut = cut.join(start.select(*by, "multiplicative"), by)
    blocks = stable(cut.groupBy(*by, "__b", "multiplicative").agg(F.array_sort(F.collect_list(F.struct("__rn", "__v"))).getField("__v").alias("__x")))  # at most ``rows`` values
    kinds = dict(blocks.dtypes)
    keys = ", ".join(f"`{k}` {kinds[k]}" for k in by)
    width = (season + 2) * (2 * (season + 2) + 2) + 1

    def first(batches):
        for pdf in batches:
            made = summarise([np.asarray(v, dtype=float) for v in pdf["__x"]], season, rows)
            yield pdf[[*by, "__b"]].assign(__s=[m.ravel() for m in made])

    def meet(batches):
        for pdf in batches:
            made = [compose([np.asarray(e["__s"]).reshape(-1, width) for e in some], season) for some in pdf["__p"]]
            yield pdf[[*by, "__b"]].assign(__s=[m.ravel() for m in made])

    schema = f"{keys}, __b bigint, __s array<double>"
    level = stable(blocks.where("not multiplicative").mapInPandas(first, schema))
    while (level.agg(F.max("__b")).head()[0] or 0) > 0:
        met = level.groupBy(*by, F.floor(F.col("__b") / FAN_IN).cast("long").alias("__up")).agg(F.array_sort(F.collect_list(F.struct("__b", "__s"))).alias("__p"))
        level = stable(met.withColumnRenamed("__up", "__b").mapInPandas(meet, schema))

    handed = start.where("multiplicative").select(*by, "__head", F.lit(None).cast("array<double>").alias("__s"))
    last = blocks.where("multiplicative").agg(F.max("__b")).head()[0] if allow_multiplicative else None

    def hand_on(batches):
        for pdf in batches:
            out = []
            for before, s, v in zip(pdf["__head"], pdf["__s"], pdf["__x"], strict=True):
                if s is None:
                    state, sse = np.tile(_start(np.asarray(before, dtype=float), season, True), (len(GRID), 1)), np.zeros(len(GRID))
                else:
                    s = np.asarray(s).reshape(len(GRID), -1)
                    state, sse = s[:, :-1], s[:, -1]
                if v is not None:
                    state, sse = multiplicative_steps(state, sse, np.asarray(v, dtype=float))
                out.append(np.column_stack([state, sse]).ravel())
            yield pdf[[*by, "__head"]].assign(__s=out)

    for b in range((last if last is not None else -1) + 1):
        own = blocks.where(F.col("multiplicative") & (F.col("__b") == b)).select(*by, "__x")
        handed = stable(handed.join(own, by, "left").mapInPandas(hand_on, f"{keys}, __head array<double>, __s array<double>"))

    def close(batches):
        for pdf in batches:
            out = []
            for head, mul, s, n in zip(pdf["__head"], pdf["multiplicative"], pdf["__s"], pdf["n"], strict=True):
                begin = _start(np.asarray(head, dtype=float), season, bool(mul))
                if mul:
                    s = np.asarray(s).reshape(len(GRID), -1)
                    state, sse = s[:, :-1], s[:, -1]
                else:
                    state, sse = _finish(None if s is None else np.asarray(s).reshape(len(GRID), -1), begin)
                i = min(range(len(GRID)), key=lambda k: (sse[k], GRID[k]))
                steps = int(n) - season
                ring = np.roll(state[i, 2:], steps % season).tolist()
                out.append((*GRID[i], float(state[i, 0]), float(state[i, 1]), ring, float(sse[i]), steps))
            names = ["alpha", "beta", "gamma", "level", "trend", "season", "sse", "steps"]
            more = pd.DataFrame(out, columns=names, index=pdf.index)
            yield pd.concat([pdf[[*by, "origin", "n"]], more, pdf[["multiplicative"]]], axis=1)

    done = level.select(*by, "__s").unionByName(handed.select(*by, "__s"))
    origin = dict(start.dtypes)["origin"]
    return start.join(done, by, "left").mapInPandas(
        close, f"{keys}, origin {origin}, n bigint, alpha double, beta double, gamma double, level double, trend double, season array<double>, sse double, steps int, multiplicative boolean")


def _start(head: np.ndarray, season: int, multiplicative: bool) -> np.ndarray:
    """State before the first step: the first season's mean, the change to the second, deviations."""
    level = head[:season].mean()
    swing = head[:season] / level if multiplicative else head[:season] - level
    return np.concatenate([[level, (head[season:2 * season].mean() - level) / season], swing])

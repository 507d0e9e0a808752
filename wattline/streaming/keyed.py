"""Streams whose state lives in Spark's keyed state store (``transformWithState``).

State variables belong to one key, are versioned and replayed with the query's checkpoint, and
expire by themselves. The drift counters wait for the watermark: rows are kept by hour until it passes,
and then taken in order of time, so rows that arrive out of order give the counters they would have given
in order; rows behind the watermark are left out. The correction keeps its history by day, drops the
days before its limit, and gives new factors with every batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR_MS, DAY_MS = 3_600_000, 86_400_000
COUNTERS = ("s", "n", "u", "umin", "page_hinkley", "cp", "cpmin", "cn", "cnmin", "max_cusum")


def millis(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy(dtype="datetime64[ms]").astype(np.int64)


def advance(state: dict, values: np.ndarray, mean: float, std: float, delta: float) -> dict:
    """Page-Hinkley and CUSUM counters after the values, in their order."""
    s = state["s"] + np.cumsum(values)
    n = state["n"] + np.arange(1, len(values) + 1)
    u = state["u"] + np.cumsum(values - s / n - delta)
    umin = np.minimum.accumulate(np.minimum(u, np.inf if state["umin"] is None else state["umin"]))
    out = {"s": s[-1], "n": int(n[-1]), "u": u[-1], "umin": umin[-1], "page_hinkley": max(state["page_hinkley"], (u - umin).max())}
    peak = state["max_cusum"]
    for c, d in (("cp", values - mean - 0.5 * std), ("cn", mean - values - 0.5 * std)):
        total = state[c] + np.cumsum(d)
        least = np.minimum.accumulate(np.minimum(total, state[f"{c}min"]))
        peak = max(peak, (total - least).max())
        out |= {c: total[-1], f"{c}min": least[-1]}
    return {k: int(v) if k == "n" else float(v) for k, v in {**out, "max_cusum": peak}.items()}


class Drift(StatefulProcessor):
    """Rows (key, ts, id, value); one row of counters for each hour that the watermark has passed."""

    def __init__(self, mean: float, std: float, delta: float) -> None:
        self.mean, self.std, self.delta = mean, std, delta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", "s double, n bigint, u double, umin double, page_hinkley double, cp double, cpmin double, cn double, cnmin double, max_cusum double")
        self.waiting = handle.getMapState("waiting", "hour bigint", "ts array<bigint>, id array<bigint>, value array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            ts = millis(pdf["ts"])
            hour = ts // HOUR_MS
            for h in np.unique(hour).tolist():
                own = hour == h
                new = (ts[own].tolist(), pdf["id"].to_numpy()[own].tolist(), pdf["value"].to_numpy(dtype=float)[own].tolist())
                if self.waiting.containsKey((h,)):
                    old = self.waiting.getValue((h,))
                    new = tuple([*o, *x] for o, x in zip(old, new, strict=True))
                else:
                    self.handle.registerTimer((h + 1) * HOUR_MS)
                self.waiting.updateValue((h,), new)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        own = expiredTimerInfo.getExpiryTimeInMs() // HOUR_MS - 1
        if not self.waiting.containsKey((own,)):  # taken along with an earlier one
            yield pd.DataFrame()
            return
        due = timerValues.getCurrentWatermarkInMs() // HOUR_MS
        hours = sorted(h for (h,) in self.waiting.keys() if h < due or h == own)
        state = dict(zip(COUNTERS, self.counters.get(), strict=True)) if self.counters.exists() else {c: 0.0 for c in COUNTERS} | {"umin": None}
        out = []
        for h in hours:
            ts, ids, values = self.waiting.getValue((h,))
            order = np.lexsort((ids, ts))
            state = advance(state, np.asarray(values, dtype=float)[order], self.mean, self.std, self.delta)
            self.waiting.removeKey((h,))
            out.append((key[0], pd.Timestamp(h * HOUR_MS, unit="ms"), state["n"], state["page_hinkley"], state["max_cusum"]))
        if out:
            self.counters.update(tuple(state[c] for c in COUNTERS))
        yield pd.DataFrame(out, columns=["area", "hour", "n", "page_hinkley", "max_cusum"])

    def close(self) -> None:
        pass


def keyed_drift(err: DataFrame, mean: float, std: float, delta: float = 0.005, watermark: str = "1 hour") -> DataFrame:
    """(area, hour, n, page_hinkley, max_cusum) over a stream of (area, ts, id, value), an hour at a time behind the watermark."""
    x = err.select("area", "ts", F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value")).withWatermark("ts", watermark)
    return x.groupBy("area").transformWithStateInPandas(
        Drift(mean, std, delta), "area string, hour timestamp, n bigint, page_hinkley double, max_cusum double", "Append", "EventTime")


class Correction(StatefulProcessor):
    """Rows (key, ts, observed, predicted); all 48 factors of the key, and its mean absolute error, after every batch."""

    def __init__(self, days: int, hours: float, decay: float, least: int) -> None:
        self.days, self.hours, self.decay, self.least = days, hours, decay, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getMapState("history", "day bigint", "ts array<bigint>, observed array<double>, predicted array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            ts = millis(pdf["ts"])
            for d in np.unique(ts // DAY_MS).tolist():
                own = ts // DAY_MS == d
                new = (ts[own].tolist(), pdf["observed"].to_numpy(dtype=float)[own].tolist(), pdf["predicted"].to_numpy(dtype=float)[own].tolist())
                if self.history.containsKey((d,)):
                    new = tuple([*o, *x] for o, x in zip(self.history.getValue((d,)), new, strict=True))
                self.history.updateValue((d,), new)
        held = sorted(d for (d,) in self.history.keys())
        newest = max(self.history.getValue((held[-1],))[0])
        first = newest - self.days * DAY_MS
        for d in [d for d in held if (d + 1) * DAY_MS <= first]:
            self.history.removeKey((d,))
        parts = [self.history.getValue((d,)) for d in held if (d + 1) * DAY_MS > first]
        ts, observed, predicted = (np.concatenate([np.asarray(p[i], dtype=float) for p in parts]) for i in range(3))
        own = (ts >= first) & ~np.isnan(observed - predicted)
        yield factors_of(key[0], ts[own].astype(np.int64), (observed - predicted)[own], newest, self.hours, self.decay, self.least)

    def close(self) -> None:
        pass


def factors_of(area: str, ts: np.ndarray, error: np.ndarray, newest: int, hours: float, decay: float, least: int) -> pd.DataFrame:
    """Weighted mean error of each half hour over the last ``hours``, else of all of them; none with fewer than ``least`` rows."""
    age = (newest - ts) / HOUR_MS
    recent = age <= hours
    columns = ["area", "asof", "period", "factor", "n", "mae"]
    if recent.sum() < least:
        return pd.DataFrame([], columns=columns)
    w, e, period = decay ** age[recent], error[recent], (ts[recent] % DAY_MS) // (HOUR_MS // 2)
    weight, total, n = (np.bincount(period, weights=v, minlength=48) for v in (w, w * e, np.ones(len(e))))
    own = np.divide(total, weight, out=np.full(48, total.sum() / weight.sum()), where=weight > 0)
    return pd.DataFrame({"area": area, "asof": pd.Timestamp(int(newest), unit="ms"), "period": np.arange(48, dtype=np.int32), "factor": own, "n": n.astype(np.int64), "mae": np.abs(error).mean()})[columns]


def keyed_correction(obs: DataFrame, max_history_days: int = 7, hours: float = 6.0, decay: float = 0.95, least: int = 3) -> DataFrame:
    """(area, asof, period, factor, n, mae) over a stream of (area, ts, observed, predicted): a set of factors for each batch and area."""
    x = obs.select("area", "ts", F.col("observed").cast("double").alias("observed"), F.col("predicted").cast("double").alias("predicted"))
    return x.groupBy("area").transformWithStateInPandas(
        Correction(max_history_days, hours, decay, least), "area string, asof timestamp, period int, factor double, n bigint, mae double", "Append", "None")


def run_keyed(stream: DataFrame) -> DataFrame:
    """``run_available`` with the state in RocksDB, which keyed state variables need."""
    from wattline.streaming.feeds import run_available

    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKSDB)
    try:
        return run_available(stream)
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)

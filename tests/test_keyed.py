"""Keyed state: same values as the batch forms over several batches, rows out of order, late rows, a restart."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from wattline.streaming import feeds as X
from wattline.streaming import keyed as K

START = dt.datetime(2024, 1, 1)


def write(spark, path, d, rows, cols):
    spark.createDataFrame(rows, cols).coalesce(1).write.parquet(f"{path}/{d}")


def test_drift_in_any_order(spark, tmp_path):
    """Rows shuffled within the watermark, one row far behind it."""
    r = random.Random(1)
    rows = [(a, START + dt.timedelta(minutes=7 * i), i, 50.0 + r.gauss(0, 5) + (8 if i > 200 else 0)) for a in ("x", "y") for i in range(400)]
    cols = "area string, ts timestamp, id int, value double"
    for d in range(4):
        part = [x for x in rows if x[2] // 100 == d]
        r.shuffle(part)
        late = [("x", START, 9999, 1e6)] if d == 3 else []
        write(spark, str(tmp_path / "in"), d, part + late, cols)
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = K.run_keyed(K.keyed_drift(stream, 50.0, 5.0, watermark="1 hour"))
    last = {x["area"]: x for x in got.groupBy("area").agg(F.max_by(F.struct("hour", "n", "page_hinkley", "max_cusum"), "hour").alias("l")).select("area", "l.*").collect()}
    end = max(x[1] for x in rows) - dt.timedelta(hours=1)
    for a in ("x", "y"):
        seen = [x for x in rows if x[0] == a and x[1].replace(minute=0) + dt.timedelta(hours=1) <= end]
        s = n = u = ph = cp = cn = peak = 0.0
        least, lp, ln = None, 0.0, 0.0
        for *_, v in seen:
            s, n = s + v, n + 1
            u += v - s / n - 0.005
            least = u if least is None else min(least, u)
            ph = max(ph, u - least)
            cp, cn = cp + v - 52.5, cn + 47.5 - v
            lp, ln = min(lp, cp), min(ln, cn)
            peak = max(peak, cp - lp, cn - ln)
        assert last[a]["n"] == len(seen)
        assert last[a]["page_hinkley"] == pytest.approx(ph) and last[a]["max_cusum"] == pytest.approx(peak)
    assert got.groupBy("area", "hour").count().where("count > 1").count() == 0


def test_correction_equals_the_table_form(spark, tmp_path):
    cols = "area string, ts timestamp, observed double, predicted double"
    for d in range(4):
        rows = [(a, START + dt.timedelta(days=3 * d, minutes=30 * i), float(50 + i % 7 + d), float(50 + i % 5)) for a in ("x", "y") for i in range(48)]
        write(spark, str(tmp_path / "in"), d, rows[::-1], cols)
    stream = lambda: spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = K.run_keyed(K.keyed_correction(stream()))
    X.stream_correction(stream(), str(tmp_path / "t"))
    want = sorted((r["area"], r["period"], round(r["factor"], 9), r["n"]) for r in X.latest(spark, str(tmp_path / "t"), "factors").collect())
    newest = got.groupBy("area").agg(F.max("asof").alias("asof"))
    last = got.join(newest, ["area", "asof"])
    assert sorted((r["area"], r["period"], round(r["factor"], 9), r["n"]) for r in last.collect()) == want
    assert got.select("asof").distinct().count() == 4
    stats = X.latest(spark, str(tmp_path / "t"), "stats").head()
    assert last.head()["mae"] == pytest.approx(stats["mae"])


def test_a_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    cols = "area string, ts timestamp, observed double, predicted double"
    spark.conf.set(K.STORE, K.ROCKSDB)
    try:
        for d in range(3):
            write(spark, str(tmp_path / "in"), d, [("x", START + dt.timedelta(hours=2 * d, minutes=30 * i), 10.0 + d, 8.0) for i in range(4)], cols)
            q = (K.keyed_correction(spark.readStream.schema(cols).parquet(f"{tmp_path}/in/*")).writeStream.format("parquet").outputMode("append")
                 .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
            q.awaitTermination()
    finally:
        spark.conf.unset(K.STORE)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 3 * 48
    last = got.where(F.col("asof") == got.agg(F.max("asof")).head()[0])
    assert last.agg(F.sum("n")).head()[0] == 12  # rows of all three runs

"""State of the streams over several batches: bounded folders, and the same result after a replay."""

import datetime as dt
import os

from pyspark.sql import functions as F

from wattline.streaming import feeds as X


def batches(spark, path, n):
    """n files of one day each, read one per batch."""
    start = dt.datetime(2024, 1, 1)
    for d in range(n):
        rows = [(a, start + dt.timedelta(days=3 * d, minutes=30 * i), float(50 + i % 7 + d), float(50 + i % 5)) for a in ("x", "y") for i in range(48)]
        spark.createDataFrame(rows, "area string, ts timestamp, observed double, predicted double").coalesce(1).write.parquet(f"{path}/{d}")
    return spark.readStream.schema("area string, ts timestamp, observed double, predicted double").option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def folders(path):
    return {p: sorted(x for x in os.listdir(f"{path}/{p}") if "=" in x) for p in os.listdir(path)}


def test_correction_history_is_bounded(spark, tmp_path):
    stream = batches(spark, str(tmp_path / "in"), 6)
    X.stream_correction(stream, str(tmp_path / "t"), max_history_days=7)
    left = folders(tmp_path / "t")
    assert len(left["factors"]) == len(left["stats"]) == 2 and len(left["history"]) == 3
    assert X.latest(spark, str(tmp_path / "t"), "factors").count() == 96


def test_drift_state_goes_on_and_replays(spark, tmp_path, monkeypatch):
    stream = batches(spark, str(tmp_path / "in"), 4).select("area", "ts", F.unix_seconds("ts").alias("id"), F.col("observed").alias("value"))
    whole = spark.read.parquet(f"{tmp_path}/in/*").select("area", "ts", F.unix_seconds("ts").alias("id"), F.col("observed").alias("value"))
    seen = []
    run = X.run_batches

    def twice(s, fn):
        def both(df, batch_id):
            fn(df, batch_id)
            if batch_id == 2:
                seen.append(batch_id)
                fn(df, batch_id)

        run(s, both)

    X.stream_drift(stream, str(tmp_path / "one"), 50.0, 5.0)
    monkeypatch.setattr(X, "run_batches", twice)
    X.stream_drift(stream, str(tmp_path / "two"), 50.0, 5.0)
    monkeypatch.setattr(X, "run_batches", lambda s, fn: fn(whole, 0))
    X.stream_drift(stream, str(tmp_path / "all"), 50.0, 5.0)
    got = [{r["area"]: (round(r["page_hinkley"], 6), round(r["max_cusum"], 6)) for r in X.latest(spark, str(tmp_path / t), "state").collect()} for t in ("one", "two", "all")]
    assert seen == [2] and got[0] == got[1] == got[2] and len(got[0]) == 2
    assert len(folders(tmp_path / "one")["state"]) == 2

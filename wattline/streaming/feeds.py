"""Structured Streaming forms of the operators that run on arriving data."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.ordered import running, seconds
from wattline.operators.intraday import correction_factors, error_model, recent_errors
from wattline.operators.quality import Rules
from wattline.sources.readers import scratch


def event_stream(spark: SparkSession, root: str, glob: str = "events.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Event feed from files; NTZ times become instants because a watermark needs them."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(root).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_load(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    w = stream.withWatermark("ts", watermark).groupBy(F.window("ts", "30 minutes"), "event_type").agg(F.sum("value").alias("load"), F.count(F.lit(1)).alias("n"))
    return w.select(F.col("event_type").alias("area"), F.col("window.start").alias("ts"), F.round("load", 2).alias("load"), "n")


def stream_dedup(stream: DataFrame, keys: Sequence[str], watermark: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(list(keys))


def stream_validate(stream: DataFrame, rules: Rules) -> DataFrame:
    ok = F.lit(True)
    for c in rules.values():
        ok = ok & F.coalesce(c, F.lit(False))
    return stream.withColumn("is_valid", ok)


def stream_align(obs: DataFrame, fc: DataFrame) -> DataFrame:
    """Observations joined to a static forecast table as they arrive."""
    return obs.join(fc.select("area", "ts", "model", "horizon", "yhat"), ["area", "ts"])


def stream_align_both(obs: DataFrame, fc: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Stream-stream form: both sides carry a watermark on ``ts``."""
    o = obs.withWatermark("ts", delay).alias("o")
    f = fc.withWatermark("ts", delay).alias("f")
    return o.join(f, F.expr("o.area = f.area and o.ts = f.ts")).select("o.area", "o.ts", "f.model", "f.horizon", "f.yhat", "o.load")


def stream_performance(err: DataFrame, watermark: str = "1 hour", size: str = "1 day", slide: str = "30 minutes") -> DataFrame:
    w = err.withWatermark("ts", watermark).groupBy(F.window("ts", size, slide), "model").agg(F.avg("abs_error").alias("mae"), F.count(F.lit(1)).alias("n"))
    return w.select("model", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mae", "n")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there, write to files, and read the result as a batch table."""
    spark = stream.sparkSession
    out, ck = scratch(spark, "stream"), scratch(spark, "stream-ckpt")
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, fn) -> None:
    q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", scratch(stream.sparkSession, "batch-ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), target


def versions(spark: SparkSession, path: str, name: str = "batch") -> list[str]:
    """Values of the folders ``name=value`` below ``path``, in order."""
    fs, target = _folder(spark, path)
    found = [x.getPath().getName() for x in fs.listStatus(target)] if fs.exists(target) else []
    values = [x.partition("=")[2] for x in found if x.startswith(f"{name}=")]
    return sorted(values, key=lambda v: (len(v), v) if name == "batch" else v)


def prune(spark: SparkSession, path: str, batches: Sequence[int]) -> None:
    for b in batches:
        fs, target = _folder(spark, f"{path}/batch={b}")
        fs.delete(target, True)


def keep_last(spark: SparkSession, path: str, batch_id: int) -> None:
    """Only this version and the one before it stay; the latter is what a replay of the batch starts from."""
    old = [int(v) for v in versions(spark, path) if int(v) < batch_id]
    prune(spark, path, old[:-1])


def stream_correction(obs: DataFrame, table: str, max_history_days: int = 7, hours: float = 6.0, decay: float = 0.95) -> None:
    """Each batch of (area, ts, observed, predicted) joins the history, which is read back to
    ``max_history_days`` before the newest row by day partition; factors and the error model
    are worked out again. A batch that is run twice overwrites its own folder. Folders of the history that
    lie wholly before that time go, and so do all versions of the results but two."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark, history = df.sparkSession, f"{table}/history"
        if df.isEmpty():
            return
        df.withColumn("day", F.to_date("ts")).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{history}/batch={batch_id}")
        days = {int(b): versions(spark, f"{history}/batch={b}", "day") for b in versions(spark, history) if int(b) <= batch_id}
        newest = date.fromisoformat(max(d[-1] for d in days.values() if d))
        first = (newest - timedelta(days=max_history_days)).isoformat()
        prune(spark, history, [b for b, d in days.items() if b != batch_id and (not d or d[-1] < first)])
        paths = [f"{history}/batch={b}/day={x}" for b, d in days.items() for x in d if x >= first]
        hist = spark.read.schema(df.schema).parquet(*paths).select("area", "ts", "observed", "predicted")
        top = hist.agg(F.max("ts")).head()[0]
        err = recent_errors(hist.where(F.col("ts") >= F.lit(top) - F.make_dt_interval(days=F.lit(max_history_days))), decay)
        correction_factors(err, hours).write.mode("overwrite").parquet(f"{table}/factors/batch={batch_id}")
        m = error_model(err)
        stats = err.agg(F.avg(F.abs("error")).alias("mae"), F.count(F.lit(1)).alias("n")).withColumns({
            "intercept": F.lit(float(m.intercept)), "w_period": F.lit(float(m.coefficients[0])), "w_weekday": F.lit(float(m.coefficients[1]))})
        stats.write.mode("overwrite").parquet(f"{table}/stats/batch={batch_id}")
        for part in ("factors", "stats"):
            keep_last(spark, f"{table}/{part}", batch_id)

    run_batches(obs, batch)


def latest(spark: SparkSession, table: str, part: str) -> DataFrame:
    return spark.read.parquet(f"{table}/{part}/batch={versions(spark, f'{table}/{part}')[-1]}")


STATE = "area string, s double, n bigint, u double, umin double, page_hinkley double, cp double, cpmin double, cn double, cnmin double, max_cusum double"


def stream_drift(err: DataFrame, table: str, mean: float, std: float, delta: float = 0.005) -> None:
    """Page-Hinkley and CUSUM counters per area over (area, ts, id, value) batches. The state is
    one row per area; inside a batch the running forms do the work."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        if df.isEmpty():
            return
        older = [v for v in versions(spark, f"{table}/state") if int(v) < batch_id]
        prev = spark.read.schema(STATE).parquet(f"{table}/state/batch={older[-1]}") if older else spark.createDataFrame([], STATE)
        st = prev.select("area", *[F.col(c).alias(f"p_{c}") for c in ("s", "n", "u", "umin", "page_hinkley", "cp", "cpmin", "cn", "cnmin", "max_cusum")])
        zero = lambda c: F.coalesce(F.col(f"p_{c}"), F.lit(0.0))
        d, hour = F.col("value") - mean, F.floor(seconds("ts") / 3600)  # blocks of raw events are hours
        x = df.join(st, "area", "left")
        x = running(x, ["area"], "ts", {"rs": ("sum", "value"), "rn": ("sum", F.lit(1)), "rp": ("sum", d - 0.5 * std), "rm": ("sum", -d - 0.5 * std)}, tie=["id"], block=hour)
        x = x.withColumns({"s": zero("s") + F.col("rs"), "n": F.coalesce("p_n", F.lit(0)) + F.col("rn"), "cp": zero("cp") + F.col("rp"), "cn": zero("cn") + F.col("rm")})
        x = running(x, ["area"], "ts", {"ru": ("sum", F.col("value") - F.col("s") / F.col("n") - delta), "m1": ("min", "cp"), "m2": ("min", "cn")}, tie=["id"], block=hour)
        x = x.withColumns({"u": zero("u") + F.col("ru"), "cpmin": F.least(zero("cpmin"), "m1"), "cnmin": F.least(zero("cnmin"), "m2")})
        x = running(x, ["area"], "ts", {"m3": ("min", "u")}, tie=["id"], block=hour)
        x = x.withColumn("umin", F.least("p_umin", "m3"))
        last = F.max_by(F.struct("s", "n", "u", "umin", "cp", "cpmin", "cn", "cnmin"), F.struct("ts", "id")).alias("l")
        peak = F.greatest(F.col("cp") - F.col("cpmin"), F.col("cn") - F.col("cnmin"))
        g = x.groupBy("area").agg(last, F.greatest(F.max(F.col("u") - F.col("umin")), F.max("p_page_hinkley"), F.lit(0.0)).alias("page_hinkley"),
                                  F.greatest(F.max(peak), F.max("p_max_cusum"), F.lit(0.0)).alias("max_cusum"))
        new = g.select("area", "l.*", "page_hinkley", "max_cusum")
        keep = prev.join(new.select("area"), "area", "left_anti")
        new.unionByName(keep).select(*[c.split()[0] for c in STATE.split(", ")]).write.mode("overwrite").parquet(f"{table}/state/batch={batch_id}")
        keep_last(spark, f"{table}/state", batch_id)

    run_batches(err, batch)

"""Boosting in blocks: a level is one job, and any number of groups grows the same trees by joins."""

import pytest
from pyspark.sql import functions as F

from wattline.operators import boosting as B


def frame(spark, n=240):
    x = spark.range(n).select(
        F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("area"), F.col("id").cast("int").alias("ts"), (F.col("id") * 7 % 11).cast("double").alias("a"),
        F.when(F.col("id") % 5 > 0, (F.col("id") * 13 % 17).cast("double")).alias("b"), F.least(F.floor(F.col("id") * 4 / n), F.lit(3)).cast("int").alias("fold"))
    return x.withColumn("y", F.col("a") * 3 + F.coalesce("b", F.lit(40.0)) + F.col("ts") % 2).cache()


def test_jobs_follow_the_levels(spark):
    df, jobs = frame(spark), []
    for rounds in (1, 4):
        spark.sparkContext.setJobGroup(f"rounds{rounds}", "")
        B.boost(df, ["a", "b"], "y", runs=B.fold_runs(2, rounds=rounds, depth=2), fold="fold")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"rounds{rounds}")))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs[1] - jobs[0] <= 3 * 2 + 2, jobs  # a job a level; the tables at the end may take one more


def test_joined_levels_give_the_same_trees(spark, monkeypatch):
    df, made = frame(spark), []
    for most in (B.MAX_NODES, 0):
        monkeypatch.setattr(B, "MAX_NODES", most)
        m = B.boost(df, ["a", "b"], "y", runs={"all": {"rounds": 2, "depth": 2, "min_rows": 5}, "late": {"rounds": 1, "depth": 1, "train_before": 2}}, fold="fold")
        nodes = {(r["area"], r["run"], r["tree"], r["node"]): (r["feature"], r["bin"], r["n"], r["value"]) for r in m.trees.collect()}
        rows = {(r["area"], r["run"], r["ts"]): (r["train"], r["target"], r["yhat"]) for r in m.fitted.collect()}
        made.append((nodes, rows, {(r["area"], r["run"]): r["base"] for r in m.base.collect()}))
    for one, other in zip(*made, strict=True):
        assert one.keys() == other.keys() and one
        for k, v in one.items():
            assert v == pytest.approx(other[k]), k

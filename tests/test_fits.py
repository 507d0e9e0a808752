"""Training tables: partitions follow the rows, and fits side by side give what single ones give."""

from pyspark.sql import functions as F

from wattline.operators import training as T
from wattline.operators.folds import beside, dealt, time_folds


def table(spark, n=400, parts=40):
    x = spark.range(0, n, 1, parts).select((F.col("id") % 2).cast("string").alias("area"), F.col("id").cast("int").alias("ts"), (F.col("id") * 7 % 31).cast("double").alias("a"))
    return x.withColumn("ts", F.timestamp_seconds(F.col("ts") * 86400)).withColumn("y", F.col("a") * 2 + F.dayofmonth("ts"))


def test_folds_of_a_fit_have_partitions_by_rows(spark, monkeypatch):
    seen, fit = [], T.train_gbt

    def watched(df, *a, **kw):
        seen.append(df.rdd.getNumPartitions())
        return fit(df, *a, **kw)

    monkeypatch.setattr(T, "train_gbt", watched)
    out = T.cv_score_pooled(table(spark).repartition(40), ["a"], "y", 2, iters=1, depth=1).collect()
    assert seen == [1, 1] and len(out) == 4


def test_dealt_keeps_every_row(spark):
    df = table(spark)
    d = dealt(df, rows=100)
    assert d.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, df.collect()))


def test_grid_scores_follow_their_points(spark):
    df = table(spark)
    both = T.tune_pooled(df, ["a"], "y", {"depth": [1, 3], "iters": [2]}).collect()
    one = {r["params"]: r["mae"] for p in ([1], [3]) for r in T.tune_pooled(df, ["a"], "y", {"depth": p, "iters": [2]}).collect()}
    assert {r["params"]: round(r["mae"], 9) for r in both} == {k: round(v, 9) for k, v in one.items()}
    assert beside(spark, lambda k: k * k, [3, 1, 2]) == [9, 1, 4] and time_folds(df, 2).count() == df.count()

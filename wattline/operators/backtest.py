"""Rolling-origin backtests."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.ordered import bounded, running, stable
from wattline.operators.metrics import metric_aggs
from wattline.operators.timeparts import period_of_day

SUMMARY = ("smape", "mae", "rmse")


def backtest_windows(spark: SparkSession, start: str, end: str, step: int = 7, max_horizon: int = 8, train_days: int = 365) -> DataFrame:
    """(window_id, train_start, train_end, test_end): training is [train_start, train_end),
    the test runs from train_end over horizons 0..max_horizon."""
    one = spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))
    n = F.floor((F.datediff("b", "a") - train_days - max_horizon) / step).cast("int")
    w = one.where(n >= 0).select("a", F.explode(F.sequence(F.lit(0), n)).alias("window_id"))
    begin = F.date_add("a", F.col("window_id") * step)
    return w.select("window_id", begin.alias("train_start"), F.date_add(begin, train_days).alias("train_end"),
                    F.date_add(begin, train_days + max_horizon).alias("test_end"))


def walk_forward(spark: SparkSession, start: str, end: str, retrain_days: int = 7, train_days: int = 365) -> DataFrame:
    """Test periods of ``retrain_days`` with the training window moving along."""
    one = spark.range(1).select(F.explode(F.sequence(
        F.date_add(F.lit(start).cast("date"), train_days), F.lit(end).cast("date"), F.make_dt_interval(days=F.lit(retrain_days)))).alias("test_start")) \
        .select(F.col("test_start").cast("date").alias("test_start"))
    return one.select(
        F.floor(F.datediff("test_start", F.lit(start).cast("date")) / retrain_days).cast("int").alias("period_id"),
        F.date_sub("test_start", train_days).alias("train_start"), F.date_sub("test_start", 1).alias("train_end"), "test_start",
        F.least(F.date_add("test_start", retrain_days - 1), F.lit(end).cast("date")).alias("test_end"))


def backtest(df: DataFrame, windows: DataFrame, step: int, train_days: int, by: Sequence[str] = ("area",), t: str = "ts",
             c: str = "load", slots: int = 48) -> DataFrame:
    """Scores of a training-mean profile and of the last training day, per window, group and horizon.

    Windows overlap, so rows are first summed per block of days that every window holds
    whole (the common divisor of step and training length); only these sums are repeated
    for each window. All joins are on equal keys.
    """
    by = list(by)
    g = gcd(step, train_days)
    origin = windows.agg(F.min("train_start").alias("__o"))  # one row
    day = F.to_date(t)
    slot = period_of_day(t, slots) if slots > 1 else F.lit(0)
    x = df.select(*by, day.alias("day"), slot.alias("slot"), F.col(c).alias("y"))
    days = windows.select("window_id", "train_end", F.explode(F.sequence("train_end", "test_end")).alias("day"))
    test = x.join(days, "day").withColumn("horizon", F.datediff("day", "train_end"))
    start = windows.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(train_days // g - 1))))
    blocks = start.select("window_id", F.date_add("train_start", F.col("__b") * g).alias("__block"))
    o = F.lit(origin.head()[0])
    block = F.date_add(o, (F.floor(F.datediff("day", o) / g) * g).cast("int"))
    sums = x.where(F.col("y").isNotNull()).groupBy(*by, "slot", block.alias("__block")).agg(F.sum("y").alias("__s"), F.count("y").alias("__n"))
    profile = sums.join(blocks, "__block").groupBy("window_id", *by, "slot").agg((F.sum("__s") / F.sum("__n")).alias("profile"))
    last = x.join(windows.select("window_id", F.date_sub("train_end", 1).alias("day")), "day").select("window_id", *by, "slot", F.col("y").alias("naive"))
    j = test.join(profile, ["window_id", *by, "slot"]).join(last, ["window_id", *by, "slot"])
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("yhat")) for m in ("profile", "naive")])
    long = j.select("window_id", *by, "horizon", "y", F.explode(cells).alias("m")).select("window_id", *by, "horizon", "y", "m.*")
    return long.where("y is not null and yhat is not null").groupBy("window_id", *by, "horizon", "model").agg(*metric_aggs())


def week_lag(lead: int) -> int:
    """Days from a target back to the same weekday, not after the origin ``lead`` days before it."""
    return 7 * -(-lead // 7)


def backtest_fitted(df: DataFrame, windows: DataFrame, max_horizon: int = 8, by: Sequence[str] = ("area",), t: str = "ts", c: str = "load", ridge: float = 1.0, step: int = 1440) -> DataFrame:
    """A ridge model per window, group and horizon on daily data: the last value before the window's end and the value of the
    same weekday, trained on the targets inside the window. (window_id, by, horizon, n, y, yhat, abs_error).

    Products of the regressors are added up along each series once. A window's normal equations are the
    difference of the sums at its two ends, two joins on equal keys, however many windows there are.
    """
    from wattline.operators.profiles import _solve

    by = list(by)
    leads = range(1, max_horizon + 2)
    far = max(week_lag(h) for h in leads)

    def make(w):
        out = {f"__l{h}": F.lag(c, h).over(w) for h in leads}
        return out | {f"__w{d}": F.lag(c, d).over(w) for d in {week_lag(h) for h in leads}}

    x = bounded(df.select(*by, t, F.col(c).cast("double").alias(c)), by, t, make, back=far, step=step)
    cells = F.array(*[F.struct(F.lit(h - 1).alias("horizon"), F.col(f"__l{h}").alias("last"), F.col(f"__w{week_lag(h)}").alias("week")) for h in leads])
    rows = stable(x.select(*by, F.col(t).alias("__t"), F.to_date(t).alias("__day"), F.col(c).alias("y"), F.explode(cells).alias("z")).select(*by, "__t", "__day", "y", "z.*"))
    cols = [F.lit(1.0), F.col("last"), F.col("week"), F.col("y")]
    known = F.col("last").isNotNull() & F.col("week").isNotNull() & F.col("y").isNotNull()
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = {f"g{i}{j}": ("sum", F.when(known, cols[i] * cols[j]).otherwise(0.0)) for i, j in pairs}
    gram = stable(running(rows, [*by, "horizon"], "__t", sums).select(*by, "horizon", "__day", *sums))
    ends = windows.select("window_id", F.date_sub("train_end", 1).alias("__day"), F.date_sub("train_start", 1).alias("__before"), "train_end")
    late = gram.join(ends, "__day").drop("__day")
    early = gram.select(*by, "horizon", F.col("__day").alias("__before"), *[F.col(g).alias(f"b{g}") for g in sums])
    both = late.join(early, [*by, "horizon", "__before"], "left")  # no row before the first day: sums start at 0
    flat = F.array(*[F.col(g) - F.coalesce(f"b{g}", F.lit(0.0)) for g in sums])
    fitted = both.select("window_id", *by, "horizon", F.date_add("train_end", F.col("horizon")).alias("__day"), flat.alias("flat")).where(F.get("flat", F.lit(0)) > 3)
    fitted = fitted.select("window_id", *by, "horizon", "__day", F.get("flat", F.lit(0)).cast("long").alias("n"), _solve("flat", F.lit(float(ridge))).alias("coef"))
    test = rows.where(known).select(*by, "horizon", "__day", "y", "last", "week").join(fitted, [*by, "horizon", "__day"])
    yhat = F.get("coef", F.lit(0)) + F.get("coef", F.lit(1)) * F.col("last") + F.get("coef", F.lit(2)) * F.col("week")
    return test.select("window_id", *by, "horizon", "n", "y", yhat.alias("yhat"), F.abs(F.col("y") - yhat).alias("abs_error"))


def backtest_summary(m: DataFrame, by: str = "area", metrics: Sequence[str] = SUMMARY) -> DataFrame:
    """mean, std, min, max over windows: overall, by horizon and by group in one pass."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in metrics:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    sets = [[F.col("model")], [F.col("model"), F.col("horizon")], [F.col("model"), F.col(by)]]
    scope = F.when(F.col("horizon").isNotNull(), "horizon").when(F.col(by).isNotNull(), by).otherwise("overall")
    return m.groupingSets(sets, "model", "horizon", by).agg(*aggs).withColumn("scope", scope)


def backtest_targets(m: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Yearly means against their limits."""
    out = m.groupBy("model").agg(*[F.avg(c).alias(c) for c in (targets or {"smape": 15.0})])
    for c, lim in (targets or {"smape": 15.0}).items():
        out = out.withColumn(f"{c}_ok", F.col(c) <= lim)
    return out

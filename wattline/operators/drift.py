"""Drift between a reference part and a test part of the same rows.

``is_ref`` is a boolean expression; ``by`` names the features or series, so any number of
them is checked in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions import tails
from wattline.functions.ordered import positions, quantiles, running, value_order
from wattline.operators.reshape import unpivot
from wattline.operators.stattests import ks_two_sample

EPS = 1e-10
# Decision limits per method.
LIMITS = {"psi": 0.1, "kl_divergence": 0.1, "wasserstein": 0.5, "cusum": 5.0, "page_hinkley": 50.0}
ALPHA = 0.05


def histogram(df: DataFrame, by: Sequence[str], v: str, is_ref: Column, bins: int = 10) -> DataFrame:
    """(by, bin, ref, test, n_ref, n_test) on equal bins over the joint range."""
    by = list(by)
    x = df.where(F.col(v).isNotNull()).withColumn("__ref", is_ref)
    s = x.groupBy(*by).agg(
        F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.count_if("__ref").alias("n_ref"), F.count_if(~F.col("__ref")).alias("n_test"))
    pad = (F.col("__hi") - F.col("__lo")) * 0.01 + EPS
    s = s.withColumns({"__a": F.col("__lo") - pad, "__w": (F.col("__hi") - F.col("__lo") + 2 * pad) / bins})
    b = F.least(F.floor((F.col(v) - F.col("__a")) / F.col("__w")), F.lit(bins - 1)).cast("int")
    c = x.join(s.select(*by, "__a", "__w"), by).groupBy(*by, b.alias("bin")).agg(
        F.count_if("__ref").alias("ref"), F.count_if(~F.col("__ref")).alias("test"))
    full = s.select(*by, "n_ref", "n_test", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    z = F.lit(0)
    return full.join(c, [*by, "bin"], "left").withColumns({"ref": F.coalesce("ref", z), "test": F.coalesce("test", z)})


def _shares(bins: int) -> tuple[Column, Column]:
    return ((F.col("ref") + EPS) / (F.col("n_ref") + EPS * bins), (F.col("test") + EPS) / (F.col("n_test") + EPS * bins))


def psi(df, by, v, is_ref, bins: int = 10) -> DataFrame:
    p, q = _shares(bins)
    return histogram(df, by, v, is_ref, bins).groupBy(*by).agg(F.sum((q - p) * F.ln(q / p)).alias("score")) \
        .withColumn("drift_detected", F.col("score") >= LIMITS["psi"])


def kl(df, by, v, is_ref, bins: int = 10) -> DataFrame:
    p, q = _shares(bins)
    return histogram(df, by, v, is_ref, bins).groupBy(*by).agg((F.sum((p - q) * F.ln(p / q)) / 2).alias("score")) \
        .withColumn("drift_detected", F.col("score") >= LIMITS["kl_divergence"])


def chi_square(df, by, v, is_ref, bins: int = 10) -> DataFrame:
    r = F.col("ref") + EPS
    t = F.col("test") * F.col("n_ref") / F.col("n_test") + EPS
    g = histogram(df, by, v, is_ref, bins).groupBy(*by).agg(F.sum((t - r) * (t - r) / r).alias("score"))
    g = g.withColumn("p_value", tails.p_chi2(F.col("score"), F.lit(bins - 1)))
    return g.withColumn("drift_detected", F.col("p_value") < ALPHA)


def wasserstein(df, by, v, is_ref) -> DataFrame:
    by = list(by)
    o = value_order(df, by, v, {"na": is_ref.cast("long"), "nb": (~is_ref).cast("long")}, next_value="__next")
    fa = (F.col("na_before") + F.col("na")) / F.col("na_total")
    fb = (F.col("nb_before") + F.col("nb")) / F.col("nb_total")
    d = o.groupBy(*by).agg(F.sum(F.abs(fa - fb) * (F.col("__next") - F.col(v))).alias("raw_distance"))
    s = df.groupBy(*by).agg(F.stddev_samp(F.when(is_ref, F.col(v))).alias("__s"))
    score = F.when(F.col("__s") > EPS, F.col("raw_distance") / F.col("__s")).otherwise(F.col("raw_distance"))
    return d.join(s, by).select(*by, "raw_distance", score.alias("score"), (score >= LIMITS["wasserstein"]).alias("drift_detected"))


def ks_drift(df, by, v, is_ref) -> DataFrame:
    k = ks_two_sample(df, by, v, is_ref)
    return k.select(*by, F.col("statistic").alias("score"), "p_value", (F.col("p_value") < ALPHA).alias("drift_detected"))


def cusum(df: DataFrame, by: Sequence[str], v: str, is_ref: Column, t: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """Both one-sided sums with k = 0.5 std, as S = C - min(0, lowest C so far)."""
    by = list(by)
    s = df.groupBy(*by).agg(F.avg(F.when(is_ref, F.col(v))).alias("__m"), F.stddev_samp(F.when(is_ref, F.col(v))).alias("__s"))
    x = df.where(~is_ref & F.col(v).isNotNull()).join(s, by)
    d, k = F.col(v) - F.col("__m"), 0.5 * F.col("__s")
    x = running(x, by, t, {"__cp": ("sum", d - k), "__cn": ("sum", -d - k)}, tie=tie)
    x = running(x, by, t, {"__mp": ("min", "__cp"), "__mn": ("min", "__cn")}, tie=tie)
    peak = F.greatest(F.col("__cp") - F.least(F.lit(0.0), "__mp"), F.col("__cn") - F.least(F.lit(0.0), "__mn"), F.lit(0.0))
    g = x.groupBy(*by).agg(F.max(peak).alias("max_cusum"), F.max("__s").alias("__s"))
    score = F.when(F.col("__s") > EPS, F.col("max_cusum") / F.col("__s")).otherwise(F.col("max_cusum"))
    return g.select(*by, "max_cusum", score.alias("score"), (score >= LIMITS["cusum"]).alias("drift_detected"))


def page_hinkley(df: DataFrame, by: Sequence[str], v: str, t: str = "ts", delta: float = 0.005, tie: Sequence[str] = ()) -> DataFrame:
    by = list(by)
    x = df.where(F.col(v).isNotNull())
    x = running(x, by, t, {"__s": ("sum", v), "__n": ("sum", F.lit(1))}, tie=tie)
    x = running(x, by, t, {"__u": ("sum", F.col(v) - F.col("__s") / F.col("__n") - delta)}, tie=tie)
    x = running(x, by, t, {"__min": ("min", "__u")}, tie=tie)
    g = x.groupBy(*by).agg(F.greatest(F.max(F.col("__u") - F.col("__min")), F.lit(0.0)).alias("score"))
    return g.withColumn("drift_detected", F.col("score") >= LIMITS["page_hinkley"])


def severity(score: Column) -> Column:
    return F.when(score < 0.1, "low").when(score < 0.2, "medium").when(score < 0.3, "high").otherwise("critical")


def drift_alerts(d: DataFrame) -> DataFrame:
    """Adds severity and action; one alert row per detected drift."""
    s = severity(F.col("score"))
    action = F.when(s == "critical", "retrain now").when(s == "high", "plan retraining, check data quality") \
        .when(s == "medium", "watch closely").otherwise("keep monitoring")
    return d.where("drift_detected").withColumns({"severity": s, "action": action})


METHODS = {
    "ks_test": ks_drift, "psi": psi, "wasserstein": wasserstein, "kl_divergence": kl, "chi_square": chi_square,
}


def drift_multi(df: DataFrame, cols: Sequence[str], is_ref: Column, method: str = "psi") -> tuple[DataFrame, DataFrame]:
    """(per feature, overall row): features become rows, so one job serves all of them."""
    long = unpivot(df.withColumn("is_ref", is_ref), ["is_ref"], cols)
    per = METHODS[method](long, ["feature"], "value", F.col("is_ref"))
    return per, per.agg(F.max("score").alias("max_score"), F.max_by("feature", "score").alias("worst_feature"), F.bool_or("drift_detected").alias("any_drift"))


def performance_drift(df: DataFrame, by: Sequence[str], e: str, is_ref: Column) -> DataFrame:
    k = ks_drift(df, by, e, is_ref)
    m = df.groupBy(*by).agg(F.avg(F.when(is_ref, F.col(e))).alias("reference_mean"), F.avg(F.when(~is_ref, F.col(e))).alias("test_mean"))
    j = k.join(m, list(by))
    inc = (F.col("test_mean") - F.col("reference_mean")) / (F.col("reference_mean") + EPS)
    return j.withColumns({
        "mean_increase": inc, "drift_detected": F.col("drift_detected") | (inc > 0.1),
        "alert": F.when(inc > 0.2, "high").when(inc > 0.1, "medium"),
    })


def drift_summary(df: DataFrame, by: Sequence[str], v: str, is_ref: Column, t: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    parts = [f(df, by, v, is_ref).select(*by, F.lit(n).alias("method"), "score", "drift_detected") for n, f in METHODS.items()]
    parts.append(cusum(df, by, v, is_ref, t, tie).select(*by, F.lit("cusum").alias("method"), "score", "drift_detected"))
    parts.append(page_hinkley(df.where(~is_ref), by, v, t, tie=tie).select(*by, F.lit("page_hinkley").alias("method"), "score", "drift_detected"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def ref_stats(df: DataFrame, by: Sequence[str], v: str, accuracy: int | None = None) -> DataFrame:
    m = df.groupBy(*by).agg(
        F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n_samples"))
    return m.join(quantiles(df, by, v, {"median": 0.5, "q25": 0.25, "q75": 0.75}, accuracy), list(by))


def metric_drift(m: DataFrame, by: Sequence[str], v: str, n: int = 7, t: str = "ts") -> DataFrame:
    """Mean and standard deviation of the last ``n`` rows against the first ``n``."""
    p = positions(m.where(F.col(v).isNotNull()), by, t, name="__i", total="__n")
    first, last = F.when(F.col("__i") <= n, F.col(v)), F.when(F.col("__i") > F.col("__n") - n, F.col(v))
    g = p.where((F.col("__i") <= n) | (F.col("__i") > F.col("__n") - n)).where(F.col("__n") >= n).groupBy(*by).agg(
        F.avg(first).alias("first_mean"), F.avg(last).alias("last_mean"), F.stddev_samp(first).alias("__fs"), F.stddev_samp(last).alias("__ls"))
    pct = F.when(F.col("first_mean") > 0, (F.col("last_mean") - F.col("first_mean")) / F.col("first_mean") * 100).otherwise(0.0)
    return g.select(
        *by, (F.col("last_mean") - F.col("first_mean")).alias("drift_absolute"), pct.alias("drift_percentage"), (F.abs(pct) > 10).alias("is_significant"),
        (F.col("__ls") - F.col("__fs")).alias("variance_drift"), (F.col("__ls") > F.col("__fs")).alias("is_increasing"))


def metric_trend(m: DataFrame, by: Sequence[str], v: str, t: str = "ts") -> DataFrame:
    p = positions(m.where(F.col(v).isNotNull()), by, t, name="__i")
    g = p.groupBy(*by).agg(F.regr_slope(F.col(v), F.col("__i").cast("double")).alias("trend_slope"))
    return g.withColumns({"is_improving": F.col("trend_slope") < 0, "is_degrading": F.col("trend_slope") > 0})


def metric_anomalies(m: DataFrame, by: Sequence[str], v: str) -> DataFrame:
    s = m.groupBy(*by).agg(F.avg(v).alias("__m"), F.stddev_pop(v).alias("__s"), F.count(v).alias("__n"))
    x = m.join(s, list(by))
    return x.where((F.col("__n") >= 3) & (F.col("__s") > 0) & (F.abs(F.col(v) - F.col("__m")) > 2 * F.col("__s"))).drop("__m", "__s", "__n")

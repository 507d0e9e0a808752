"""Statistical tests. Statistics come from aggregates and distributed ranks; p-values are
worked out on the aggregated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.functions import tails
from wattline.functions.ordered import average_rank, bounded, quantiles, value_order


def _moments(df: DataFrame, by: Sequence[str], d: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("std_diff"))


def paired_t(df: DataFrame, by: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    m = _moments(df, by, F.col(a) - F.col(b))
    s = F.when(F.col("std_diff") > 0, F.col("std_diff"))
    m = m.withColumns({"t": F.col("mean_diff") / (s / F.sqrt("n")), "effect_size": F.col("mean_diff") / s})
    return m.withColumn("p_value", F.coalesce(tails.p_t(F.col("t"), F.col("n") - 1), F.lit(1.0)))


def wilcoxon(df: DataFrame, by: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Signed ranks of the non-zero differences, ties averaged, normal approximation."""
    d = df.select(*by, (F.col(a) - F.col(b)).alias("__d")).where("__d <> 0")
    d = d.withColumn("__a", F.abs("__d"))
    o = value_order(d, by, "__a", {"n": F.lit(1), "pos": (F.col("__d") > 0).cast("long")})
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    g = o.groupBy(*by).agg(
        F.max("n_total").alias("n"), F.sum(F.col("pos") * rank).alias("w_plus"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(3)) - F.col("n")).alias("__tie"),
    )
    n = F.col("n").cast("double")
    total = n * (n + 1) / 2
    g = g.withColumn("statistic", F.least(F.col("w_plus"), total - F.col("w_plus")))
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("__tie") / 48
    g = g.withColumn("z", (F.col("statistic") - total / 2) / F.sqrt(var))
    return g.withColumn("p_value", tails.p_normal(F.col("z"))).drop("__tie")


def two_sample(df: DataFrame, by: Sequence[str], v: str, is_a: Column, test: str = "t") -> DataFrame:
    """Rows where ``is_a`` holds against the others: pooled t-test or Mann-Whitney U."""
    if test == "t":
        x, y = F.when(is_a, F.col(v)), F.when(~is_a, F.col(v))
        g = df.groupBy(*by).agg(
            F.count(x).alias("n_a"), F.count(y).alias("n_b"), F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"),
            F.var_samp(x).alias("__va"), F.var_samp(y).alias("__vb"))
        dof = F.col("n_a") + F.col("n_b") - 2
        pooled = ((F.col("n_a") - 1) * F.col("__va") + (F.col("n_b") - 1) * F.col("__vb")) / dof
        t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b")))
        return g.withColumn("statistic", t).withColumn("p_value", tails.p_t(F.col("statistic"), dof)).drop("__va", "__vb")
    if test != "mann_whitney":
        raise ValueError(f"unknown test {test!r}")
    o = value_order(df, by, v, {"n": F.lit(1), "na": is_a.cast("long")})
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    g = o.groupBy(*by).agg(
        F.max("na_total").alias("n_a"), (F.max("n_total") - F.max("na_total")).alias("n_b"), F.sum(F.col("na") * rank).alias("__r"),
        F.sum(F.pow(F.col("n").cast("double"), F.lit(3)) - F.col("n")).alias("__tie"))
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    g = g.withColumn("statistic", F.col("__r") - na * (na + 1) / 2)
    sd = F.sqrt(na * nb / 12 * ((n + 1) - F.col("__tie") / (n * (n - 1))))
    z = (F.abs(F.col("statistic") - na * nb / 2) - 0.5) / sd
    return g.withColumn("p_value", F.least(tails.p_normal(z), F.lit(1.0))).drop("__r", "__tie")


def effect_size(df: DataFrame, by: Sequence[str], v: str, is_a: Column) -> DataFrame:
    x, y = F.when(is_a, F.col(v)), F.when(~is_a, F.col(v))
    g = df.groupBy(*by).agg(
        F.avg(x).alias("mean_a"), F.avg(y).alias("mean_b"),
        F.sqrt(((F.count(x) - 1) * F.var_samp(x) + (F.count(y) - 1) * F.var_samp(y)) / (F.count(x) + F.count(y) - 2)).alias("__s"))
    return g.select(*by, F.when(F.col("__s") > 0, (F.col("mean_a") - F.col("mean_b")) / F.col("__s")).otherwise(0.0).alias("cohens_d"))


def mean_ci(df: DataFrame, by: Sequence[str], v: str, level: float = 0.95) -> DataFrame:
    g = df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("se"))
    g = g.withColumn("__q", tails.q_t(F.lit(level), F.col("n") - 1))
    return g.withColumns({"lo": F.col("mean") - F.col("__q") * F.col("se"), "hi": F.col("mean") + F.col("__q") * F.col("se")}).drop("__q")


def anova(df: DataFrame, by: Sequence[str], group: str, v: str) -> DataFrame:
    """One-way F from group counts, means and variances."""
    g = df.where(F.col(v).isNotNull()).groupBy(*by, group).agg(
        F.count(v).alias("__n"), F.avg(v).alias("__m"), (F.var_pop(v) * F.count(v)).alias("__ss"))
    total = F.sum("__n")
    between = F.sum(F.col("__n") * F.col("__m") * F.col("__m")) - F.pow(F.sum(F.col("__n") * F.col("__m")), F.lit(2)) / total
    a = g.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), total.alias("n"), between.alias("__b"), F.sum("__ss").alias("__w"))
    d1, d2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    a = a.withColumn("statistic", (F.col("__b") / d1) / (F.col("__w") / d2))
    return a.withColumn("p_value", tails.p_f(F.col("statistic"), d1, d2)).drop("__b", "__w")


def kruskal(df: DataFrame, by: Sequence[str], group: str, v: str) -> DataFrame:
    by = list(by)
    ranks = average_rank(df, by, v, "__rank")
    counts = df.where(F.col(v).isNotNull()).groupBy(*by, group, v).agg(F.count(F.lit(1)).alias("__c"))
    g = counts.join(ranks, [*by, v]).groupBy(*by, group).agg(
        F.sum(F.col("__c") * F.col("__rank")).alias("__r"), F.sum("__c").alias("__n"), F.max("n_total").alias("__all"))
    tie = ranks.groupBy(*by).agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(3)) - F.col("n")).alias("__tie"))
    h = g.groupBy(*by).agg(F.count(F.lit(1)).alias("groups"), F.max("__all").cast("double").alias("__all"), F.sum(F.col("__r") * F.col("__r") / F.col("__n")).alias("__s"))
    n = F.col("__all")
    stat = (12 / (n * (n + 1)) * F.col("__s") - 3 * (n + 1)) / (1 - F.col("__tie") / (n * n * n - n))
    h = h.join(tie, by).select(*by, "groups", n.cast("long").alias("n"), stat.alias("statistic"))
    return h.withColumn("p_value", tails.p_chi2(F.col("statistic"), F.col("groups") - 1))


def levene(df: DataFrame, by: Sequence[str], group: str, v: str, accuracy: int | None = None) -> DataFrame:
    keys = [*by, group]
    med = quantiles(df, keys, v, {"__med": 0.5}, accuracy)
    z = df.join(med, keys).withColumn("__z", F.abs(F.col(v) - F.col("__med")))
    return anova(z, by, group, "__z")


def ks_two_sample(df: DataFrame, by: Sequence[str], v: str, is_a: Column) -> DataFrame:
    o = value_order(df, by, v, {"na": is_a.cast("long"), "nb": (~is_a).cast("long")})
    fa = (F.col("na_before") + F.col("na")) / F.col("na_total")
    fb = (F.col("nb_before") + F.col("nb")) / F.col("nb_total")
    g = o.groupBy(*by).agg(F.max(F.abs(fa - fb)).alias("statistic"), F.max("na_total").alias("n_a"), F.max("nb_total").alias("n_b"))
    return g.withColumn("p_value", tails.p_ks(F.col("statistic"), F.col("n_a").cast("double"), F.col("n_b").cast("double")))


def normality(df: DataFrame, by: Sequence[str], v: str, alpha: float = 0.05) -> DataFrame:
    """Jarque-Bera and Anderson-Darling; normal when neither rejects."""
    by = list(by)
    m = df.where(F.col(v).isNotNull()).groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("__m"), F.stddev_samp(v).alias("__s"), F.skewness(v).alias("__g1"), F.kurtosis(v).alias("__g2"))
    m = m.withColumn("jb", F.col("n") / 6 * (F.col("__g1") * F.col("__g1") + F.col("__g2") * F.col("__g2") / 4))
    o = value_order(df, by, v, {"c": F.lit(1)}).join(m.select(*by, "__m", "__s"), by)
    z = (F.col(v) - F.col("__m")) / F.col("__s")
    o = o.withColumn("__f", F.greatest(F.least(tails.cdf_normal(z), F.lit(1 - 1e-15)), F.lit(1e-300)))
    c, before, total = F.col("c"), F.col("c_before"), F.col("c_total")
    term = c * (2 * before + c) * F.ln("__f") + c * (2 * (total - before) - c) * F.ln(1 - F.col("__f"))
    ad = o.groupBy(*by).agg((-F.max(total) - F.sum(term) / F.max(total)).alias("__ad"))
    out = m.join(ad, by).withColumn("ad", F.col("__ad") * (1 + 0.75 / F.col("n") + 2.25 / (F.col("n") * F.col("n"))))
    out = out.withColumn("jb_p_value", tails.p_chi2(F.col("jb"), F.lit(2)))
    # 0.752: 5% point of the adjusted statistic with estimated mean and variance
    return out.select(*by, "n", "jb", "jb_p_value", "ad", ((F.col("jb_p_value") >= alpha) & (F.col("ad") < 0.752)).alias("is_normal"))


def diebold_mariano(df: DataFrame, by: Sequence[str], a: str = "yhat_a", b: str = "yhat_b", y: str = "y", h: int = 1,
                    order: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """Squared loss; autocovariances of the loss difference up to h - 1 lags."""
    by = list(by)
    sq = lambda c: (F.col(y) - F.col(c)) * (F.col(y) - F.col(c))
    d = df.select(*by, order, *tie, (sq(a) - sq(b)).alias("__d"))
    if h > 1:
        d = bounded(d, by, order, lambda w: {f"__d{k}": F.lag("__d", k).over(w) for k in range(1, h)}, back=h - 1, tie=tie)
    gam = [F.covar_samp(F.col("__d"), F.col(f"__d{k}")) for k in range(1, h)]
    extra = sum(gam[1:], gam[0]) if gam else F.lit(0.0)
    g = d.groupBy(*by).agg(F.count("__d").alias("n"), F.avg("__d").alias("mean_loss_diff"), (F.var_samp("__d") + 2 * extra).alias("__v"))
    g = g.withColumn("dm", F.col("mean_loss_diff") / F.sqrt(F.greatest(F.col("__v"), F.lit(1e-10)) / F.col("n"))).drop("__v")
    return g.withColumn("p_value", tails.p_normal(F.col("dm")))

"""Transmission losses: generation, consumption and loss nodes tagged by ``role``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.moments import correlation
from wattline.functions.ordered import positions


@dataclass(frozen=True)
class LossConfig:
    # Default share, limits, window and load scale of the loss models.
    default: float = 0.08
    low: float = 0.0
    high: float = 0.15
    window: int = 168
    scale: float = 0.001
    reference_load: float = 10000.0


def by_role(df: DataFrame, keys: Sequence[str] = ("ts",)) -> DataFrame:
    part = lambda r: F.sum(F.when(F.col("role") == r, F.col("y")))
    return df.groupBy(*keys).agg(part("generation").alias("generation"), part("consumption").alias("consumption"), part("losses").alias("losses"))


def losses(df: DataFrame, model: str = "percentage", cfg: LossConfig = LossConfig(), by: Sequence[str] = (), history: DataFrame | None = None,
           tol: float = 1e-6) -> DataFrame:
    """Loss per time stamp. Where the balance does not hold afterwards, the default share is
    used (the absolute model always balances)."""
    keys = [*by, "ts"]
    x = by_role(df, keys).drop("losses")
    g, c = F.col("generation"), F.col("consumption")
    clip = lambda v: F.greatest(F.least(v, F.lit(cfg.high)), F.lit(cfg.low))
    if model == "percentage":
        y = g * cfg.default
    elif model == "absolute":
        y = F.greatest(g - c, F.lit(0.0))
    elif model == "historical":
        tag = [*by] or ["__g"]
        h = history if by else history.withColumn("__g", F.lit(1))
        p = positions(h, tag, "ts", name="__i", total="__n").where(F.col("__i") > F.col("__n") - cfg.window)
        s = p.groupBy(*tag).agg(F.avg("share").alias("__s"), F.max("__n").alias("__n"))
        x = x.join(s, list(by)) if by else x.join(s.drop("__g"))  # one row
        y = g * F.when(F.col("__n") < cfg.window, F.lit(cfg.default)).otherwise(clip(F.col("__s")))
    elif model == "adaptive":
        s = x.groupBy(*by).agg(F.avg("consumption").alias("__m"))
        x = x.join(s, list(by)) if by else x.join(s)  # one row
        y = g * clip(cfg.default + F.col("__m") / cfg.reference_load * cfg.scale)
    else:
        raise ValueError(f"unknown loss model {model!r}")
    ok = F.abs(g - c - y) < tol * F.greatest(F.abs(g), F.lit(1.0))
    return x.select(*keys, "generation", "consumption", y.alias("losses"), ok.alias("balanced"))


def rebalance(x: DataFrame, cfg: LossConfig = LossConfig()) -> DataFrame:
    """Unbalanced rows get the default share."""
    return x.withColumn("losses", F.when(F.col("balanced"), F.col("losses")).otherwise(F.col("generation") * cfg.default))


def distribute_losses(total: DataFrame, loads: DataFrame, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """``total(ts, losses)`` spread over ``loads(ts, node, y)`` in proportion to load."""
    s = loads.groupBy(*keys).agg(F.sum("y").alias("__s"))
    share = F.col("y") / F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    return loads.join(s.join(total.select(*keys, "losses"), list(keys)), list(keys)).select(
        *keys, F.concat("node", F.lit("_Losses")).alias("node"), (share * F.col("losses")).alias("losses"))


def adjust_losses(df: DataFrame, share: float = 0.08) -> DataFrame:
    """Loss nodes scaled so that together they are ``share`` of generation."""
    s = by_role(df).select("ts", (F.col("generation") * share).alias("__t"), F.col("losses").alias("__l"))
    k = df.where("role = 'losses'").groupBy("ts").agg(F.count(F.lit(1)).alias("__k"))
    part = F.when(F.col("__l") > 0, F.col("y") / F.col("__l")).otherwise(1 / F.col("__k"))
    y = F.when(F.col("role") == "losses", part * F.col("__t")).otherwise(F.col("y"))
    return df.join(s.join(k, "ts", "left"), "ts").select("ts", "node", "role", y.alias("y"))


def validate_losses(x: DataFrame, cfg: LossConfig = LossConfig()) -> DataFrame:
    """``x(ts, generation, consumption, losses)`` -> one row of errors and warnings."""
    a = x.agg(
        F.count_if(F.col("losses") < 0).alias("negative_losses"), (F.avg("losses") / F.avg("generation")).alias("mean_share"),
        F.max(F.abs(F.col("generation") - F.col("consumption") - F.col("losses"))).alias("max_balance_error"))
    return a.withColumns({
        "above_maximum": F.col("mean_share") > cfg.high, "below_minimum": F.col("mean_share") < cfg.low,
        "balance_warning": F.col("max_balance_error") > 1.0,
        "valid": (F.col("negative_losses") == 0) & (F.col("mean_share") <= cfg.high),
    })


def loss_stats(x: DataFrame) -> DataFrame:
    s = x.where(F.col("generation") > 0).withColumn("pct", 100 * F.col("losses") / F.col("generation"))
    ok = F.col("consumption") > 0
    a = s.agg(
        F.avg("pct").alias("mean_pct"), F.stddev_pop("pct").alias("std_pct"), F.min("pct").alias("min_pct"), F.max("pct").alias("max_pct"),
        correlation(F.when(ok, F.col("consumption")), F.when(ok, F.col("pct"))).alias("load_correlation"))
    rng = lambda part, n: s.groupBy(part.alias("k")).agg(F.avg("pct").alias("m")).agg((F.max("m") - F.min("m")).alias(n))
    return a.join(rng(F.hour("ts"), "hourly_range")).join(rng(F.weekday("ts"), "weekly_range"))  # frames of one row


def fit_loss_model(x: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    share = F.col("losses") / F.col("generation")
    return x.where(F.col("generation") > 0).groupBy(*by).agg(
        F.regr_slope(share, F.col("consumption")).alias("slope"), F.regr_intercept(share, F.col("consumption")).alias("intercept"), F.count(F.lit(1)).alias("n"))

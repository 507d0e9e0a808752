"""Validation, filtering and data-quality reports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.ordered import bounded, positions, seconds, uniform
from wattline.sources.tables import regular_grid

# Enumerations used by the row rules.
TEMPERATURE_SOURCES = ["D+1", "D+2", "ECMWF", "weighted"]
HOLIDAY_TYPES = ["National", "Regional", "Municipal"]

Rules = Mapping[str, Column]


def load_rules(areas: Sequence[str], area="area", value="load", mmgd: str | None = None) -> Rules:
    rules = {area: F.col(area).isin(list(areas)), value: F.col(value) > 0}
    if mmgd:
        rules[mmgd] = F.col(mmgd).isNull() | (F.col(mmgd) >= 0)
    return rules


def temperature_rules(areas: Sequence[str], area="area", value="temp_celsius", source="source") -> Rules:
    return {
        area: F.col(area).isin(list(areas)), value: F.col(value).between(-10, 50),
        source: F.col(source).isin(TEMPERATURE_SOURCES),
    }


def heat_rules(areas: Sequence[str], area="area", value="heat_index") -> Rules:
    return {area: F.col(area).isin(list(areas)), value: F.col(value).between(15, 55)}


def holiday_rules(areas: Sequence[str]) -> Rules:
    return {
        "id_tipodiaespecial": F.col("id_tipodiaespecial").between(0, 10),
        "holiday_type": F.col("holiday_type").isin(HOLIDAY_TYPES),
        "affected_areas": F.forall("affected_areas", lambda a: a.isin(list(areas))),
    }


def _holds(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def flag_rules(df: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``errors``: the fields whose rule fails."""
    bad = F.array_compact(F.array(*[F.when(~_holds(c), F.lit(n)) for n, c in rules.items()]))
    return df.withColumn("errors", bad)


def validate(df: DataFrame, rules: Rules, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    flagged = flag_rules(df, rules)
    if strict:
        msg = F.concat(F.lit("invalid row: "), F.concat_ws(",", "errors"))
        flagged = flagged.withColumn("errors", F.when(F.size("errors") > 0, F.raise_error(msg)).otherwise(F.col("errors")))
    return flagged.where(F.size("errors") == 0).drop("errors"), flagged.where(F.size("errors") > 0)


def validation_report(df: DataFrame, rules: Rules, samples: int = 10) -> tuple[DataFrame, DataFrame]:
    """(one row of totals with a count per field, sample of invalid rows)."""
    ok = F.lit(True)
    for c in rules.values():
        ok = ok & _holds(c)
    totals = df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~ok).alias("invalid"),
        *[F.count_if(~_holds(c)).alias(f"errors_{n}") for n, c in rules.items()],
    )
    return totals, flag_rules(df, rules).where(F.size("errors") > 0).limit(samples)


def expected_records(df: DataFrame, by: Sequence[str] = ("area",), t: str = "ts") -> DataFrame:
    """Rows per day of each group from its most frequent time gap (shortest on ties)."""
    by = list(by)
    gaps = bounded(df.select(*by, t), by, t, lambda w: {"__prev": F.lag(t).over(w)}, back=1)
    gaps = gaps.where("__prev is not null").select(*by, ((seconds(t) - seconds("__prev")) / 60).alias("gap"))
    counts = gaps.groupBy(*by, "gap").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy(*by).agg(F.max_by("gap", F.struct(F.col("n"), -F.col("gap"))).alias("gap_minutes"))
    per_day = F.when(F.col("gap_minutes").between(25, 35), 48).when(F.col("gap_minutes").between(55, 65), 24).otherwise(48)
    return mode.withColumn("expected", per_day)


def day_stats(df: DataFrame, by=("area",), t="ts", value_cols: Sequence[str] = (), expected: int | DataFrame = 48,
              max_missing_pct: float = 0.0) -> DataFrame:
    """Per (group, day): record count, worst missing share, and why the day is rejected."""
    by = list(by)
    missing = [F.avg(F.col(c).isNull().cast("double")) for c in value_cols] or [F.lit(0.0)]
    g = df.groupBy(*by, F.to_date(t).alias("day")).agg(
        F.count(F.lit(1)).alias("records"),
        (F.greatest(*missing) if len(missing) > 1 else missing[0]).alias("missing_pct"),
    )
    g = g.join(expected.select(*by, "expected"), by) if isinstance(expected, DataFrame) else g.withColumn("expected", F.lit(expected))
    reason = (
        F.when(F.col("records") < F.col("expected"), "insufficient_records")
        .when(F.col("records") > F.col("expected"), "excess_records")
        .when(F.col("missing_pct") > max_missing_pct, "too_many_missing")
    )
    return g.withColumn("reason", reason)


def complete_days(df: DataFrame, by=("area",), t="ts", value_cols=(), expected: int | DataFrame = 48, max_missing_pct: float = 0.0) -> DataFrame:
    good = day_stats(df, by, t, value_cols, expected, max_missing_pct).where("reason is null")
    keys = good.select(*by, F.col("day").alias("__day"))
    return df.withColumn("__day", F.to_date(t)).join(keys, [*by, "__day"], "left_semi").drop("__day")


def filter_report(df: DataFrame, by=("area",), t="ts", value_cols=(), expected: int | DataFrame = 48, max_missing_pct: float = 0.0) -> DataFrame:
    """One row of totals; ``affected_areas`` is null if every day is complete, the rate NaN if there is no day."""
    s = day_stats(df, by, t, value_cols, expected, max_missing_pct)
    n = F.count(F.lit(1))
    affected = F.array_sort(F.collect_set(F.when(F.col("reason").isNotNull(), F.col(by[0]))))
    return s.agg(
        n.alias("total_days"), F.count_if(F.col("reason").isNull()).alias("complete_days"),
        F.count_if(F.col("reason").isNotNull()).alias("incomplete_days"),
        *[F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(r)
          for r in ("insufficient_records", "excess_records", "too_many_missing")],
        F.when(F.count("reason") > 0, affected).alias("affected_areas"),
        F.when(n > 0, F.count_if(F.col("reason").isNull()) / n).otherwise(float("nan")).alias("retention_rate"),
    )


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a stated order, as an aggregate (combined before the shuffle)."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")
    return df.groupBy(*keys).agg(pick).select(*keys, "__r.*").select(*df.columns)


def dedup_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("kept"), F.sum(F.col("n") - 1).alias("removed"))


def find_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return df.join(many, list(keys), "left_semi")


def check_sorted(df: DataFrame, by: Sequence[str], t: str, arrival: str, rows_per_block: int = 1_000_000) -> DataFrame:
    """Per group: rows, and rows that arrive with an earlier time than their predecessor."""
    block = F.floor(F.col(arrival) / rows_per_block)
    o = bounded(df.select(*by, t, arrival), by, arrival, lambda w: {"__prev": F.lag(t).over(w)}, back=1, block=block)
    return o.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.col("__prev") > F.col(t), F.lit(False))).alias("out_of_order"),
    ).withColumn("is_sorted", F.col("out_of_order") == 0)


def find_gaps(df: DataFrame, by: Sequence[str] = ("area",), t: str = "ts", minutes: int = 30) -> DataFrame:
    return regular_grid(df, by, t, minutes).join(df.select(*by, t), [*by, t], "left_anti")


def validate_features(df: DataFrame, expected: Sequence[str], allow_null: Sequence[str] = (), pattern: str = r"^[a-z][a-z0-9_]*$") -> tuple[dict, DataFrame]:
    """Schema findings (known from the plan) and null counts of the columns that must be full."""
    cols = df.columns
    schema = {
        "missing": [c for c in expected if c not in cols], "extra": [c for c in cols if c not in expected],
        "duplicates": sorted({c for c in cols if cols.count(c) > 1}),
        "bad_names": [c for c in cols if not re.match(pattern, c)],
    }
    return schema, null_counts(df, [c for c in expected if c in cols and c not in allow_null])


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    a = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return a.unpivot(["rows"], list(cols), "feature", "nulls").withColumn("null_pct", F.col("nulls") / F.col("rows"))


def check_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("duplicated_keys"),
        (F.max("n") == 1).alias("is_unique"),
    )


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, nulls, mean, std, min, max per numeric column, in one pass."""
    one = df.agg(*[
        F.struct(
            F.count(c).alias("count"), F.count_if(F.col(c).isNull()).alias("nulls"),
            (F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias("null_pct"), F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
        ).alias(c) for c in cols
    ])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in cols])).alias("x")) \
        .select("x.feature", "x.s.*")


def sparse_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    a = df.agg(*[F.avg(F.when(F.col(c).isNull() | (F.col(c) == 0), 1.0).otherwise(0.0)).alias(c) for c in cols])
    return a.unpivot([], list(cols), "feature", "sparse_share").withColumn("is_sparse", F.col("sparse_share") >= threshold)


def duplicate_columns(df: DataFrame, cols: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Columns with equal content as an earlier one: one hash sum per column in one pass."""
    h = df.agg(*[F.sum(F.xxhash64(F.col(c).cast("string"), *key).cast("decimal(38,0)")).alias(c) for c in cols])
    pos = {c: i for i, c in enumerate(cols)}
    long = h.unpivot([], list(cols), "feature", "h")
    first = long.groupBy("h").agg(F.min_by("feature", F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])[F.col("feature")]).alias("same_as"))
    return long.join(first, "h").where("feature <> same_as").select("feature", "same_as")


def series_fitness(df: DataFrame, by=("area",), value="load", min_obs: int = 14) -> DataFrame:
    a = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_observations"), F.count_if(F.col(value).isNull()).alias("n_missing"),
        F.coalesce(F.stddev_samp(value) > 0, F.lit(False)).alias("has_variance"),
        F.count_if(F.coalesce(F.col(value) < 0, F.lit(False))).alias("n_negative"),
    )
    issues = F.array_compact(F.array(
        F.when(F.col("n_observations") < min_obs, "too_few"), F.when(F.col("n_missing") > 0, "missing"),
        F.when(~F.col("has_variance"), "no_variance"), F.when(F.col("n_negative") > 0, "negative"),
    ))
    return a.withColumn("issues", F.concat_ws(",", issues)).withColumn("is_valid", F.size(issues) == 0)


def inject_missing(df: DataFrame, cols: Sequence[str], rate: float, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Cells nulled with probability ``rate``, decided by a hash of the key and column."""
    return df.withColumns({
        c: F.when(uniform(seed, F.lit(c), *key) < rate, F.lit(None)).otherwise(F.col(c)) for c in cols
    })


def inject_outliers(df: DataFrame, cols: Sequence[str], rate: float, magnitude: float, key: Sequence[str], by=("area",), seed: int = 42) -> DataFrame:
    stats = df.groupBy(*by).agg(*[s for c in cols for s in (F.avg(c).alias(f"__m_{c}"), F.stddev_samp(c).alias(f"__s_{c}"))])
    j = df.join(stats, list(by))
    sign = lambda c: F.when(uniform(seed + 1, F.lit(c), *key) < 0.5, -1.0).otherwise(1.0)
    out = j.withColumns({
        c: F.when(uniform(seed, F.lit(c), *key) < rate, F.col(f"__m_{c}") + sign(c) * magnitude * F.col(f"__s_{c}")).otherwise(F.col(c))
        for c in cols
    })
    return out.select(*df.columns)


def inject_gaps(df: DataFrame, by=("area",), t="ts", gap_size: int = 48, num_gaps: int = 3, seed: int = 42) -> DataFrame:
    """Drops ``num_gaps`` runs of ``gap_size`` consecutive rows per group."""
    by = list(by)
    p = positions(df, by, t, name="__rn")
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    starts = n.withColumn("__g", F.explode(F.sequence(F.lit(1), F.lit(num_gaps)))).withColumn(
        "__s", F.floor(uniform(seed, *by, "__g") * F.greatest(F.col("__n") - gap_size + 1, F.lit(1))).cast("int") + 1
    )
    hit = starts.select(*by, F.explode(F.sequence(F.col("__s").cast("long"), F.col("__s").cast("long") + gap_size - 1)).alias("__rn")).distinct()
    return p.withColumn("__rn", F.col("__rn").cast("long")).join(hit, [*by, "__rn"], "left_anti").drop("__rn")


def inject_type_errors(df: DataFrame, c: str, rate: float, key: Sequence[str], seed: int = 42) -> DataFrame:
    return df.withColumn(c, F.when(uniform(seed, F.lit(c), *key) < rate, F.lit("corrupt")).otherwise(F.col(c).cast("string")))


def recover_types(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.col(c).try_cast("double"))


def drop_sparse_models(fc: DataFrame, threshold: float = 0.5) -> DataFrame:
    per_h = fc.groupBy("model", "horizon").agg(F.avg(F.col("yhat").isNull().cast("double")).alias("m"))
    keep = per_h.groupBy("model").agg(F.avg("m").alias("m")).where(F.col("m") <= threshold).select("model")
    return fc.join(keep, "model", "left_semi")


def synth_series(spark: SparkSession, areas: Sequence[str], days: int, seed: int = 42, start: str = "2024-01-01") -> DataFrame:
    """Load, temperature and holiday flag with a daily and a weekly cycle; for tests."""
    i = F.col("i")
    noise = lambda k: F.sqrt(-2 * F.log(1 - uniform(seed, F.lit(k), "area", "i"))) * F.cos(2 * F.pi() * uniform(seed + 1, F.lit(k), "area", "i"))
    base = spark.range(days * 48).withColumnRenamed("id", "i").withColumn("area", F.explode(F.array(*[F.lit(a) for a in areas])))
    ts = F.lit(start + " 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(i * 30).cast("int"))
    daily = F.sin((i % 48) * (2 * F.pi() / 48))
    return base.withColumn("ts", ts).select(
        "area", "ts", (1000 + 150 * daily - 80 * (F.weekday("ts") >= 5).cast("int") + 20 * noise("load")).alias("load"),
        (25 + 5 * daily + noise("temp")).alias("temperature"),
        ((F.month("ts") * 100 + F.dayofmonth("ts")).isin([101, 1225])).cast("int").alias("is_holiday"),
    )



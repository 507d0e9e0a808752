"""Holiday calendar. Everything is first worked out on one row per date, a table whose
size is fixed by the year range (366 rows a year), and then joined to the data once."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# National holidays as (month, day, name), and Easter offsets in days.
FIXED = [
    (1, 1, "Ano Novo"), (4, 21, "Tiradentes"), (5, 1, "Dia do Trabalho"), (9, 7, "Independencia"),
    (10, 12, "Nossa Senhora Aparecida"), (11, 2, "Finados"), (11, 15, "Proclamacao da Republica"),
    (11, 20, "Consciencia Negra"), (12, 25, "Natal"),
]
MOVABLE = [(-47, "Carnaval"), (-2, "Sexta-feira Santa"), (60, "Corpus Christi")]


def _easter(df: DataFrame) -> DataFrame:
    """Gregorian Easter (Meeus/Jones/Butcher) from integer columns."""
    for name, e in [
        ("a", "y % 19"), ("b", "y div 100"), ("c", "y % 100"), ("d", "b div 4"), ("e", "b % 4"),
        ("g", "(b - (b + 8) div 25 + 1) div 3"), ("h", "(19 * a + b - d - g + 15) % 30"),
        ("l", "(32 + 2 * e + 2 * (c div 4) - h - c % 4) % 7"), ("m", "(a + 11 * h + 22 * l) div 451"),
        ("n", "h + l - 7 * m + 114"),
    ]:
        df = df.withColumn(name, F.expr(e))
    return df.withColumn("easter", F.expr("make_date(y, n div 31, n % 31 + 1)"))


def holiday_calendar(spark: SparkSession, y0: int, y1: int, custom: Iterable[tuple[str, str]] = (), movable: bool = True) -> DataFrame:
    """(date, holiday_name) for the years y0..y1; one row per date."""
    years = spark.range(y0, y1 + 1).select(F.col("id").cast("int").alias("y"))
    entries = [F.struct(F.expr(f"make_date(y, {m}, {d})").alias("date"), F.lit(n).alias("holiday_name")) for m, d, n in FIXED]
    if movable:
        years = _easter(years)
        entries += [F.struct(F.date_add("easter", k).alias("date"), F.lit(n).alias("holiday_name")) for k, n in MOVABLE]
    cal = years.select(F.explode(F.array(*entries)).alias("h")).select("h.*")
    custom = list(custom)
    if custom:
        extra = spark.createDataFrame(custom, "date string, holiday_name string").withColumn("date", F.col("date").cast("date"))
        cal = cal.unionByName(extra)
    return cal.groupBy("date").agg(F.min("holiday_name").alias("holiday_name"))


def calendar_days(cal: DataFrame) -> DataFrame:
    """One row per date with holiday, bridge, pre/post flags and the next holiday."""
    by_year = Window.orderBy("date")  # the calendar only: a dozen rows per year
    spans = cal.withColumn("__prev", F.lag("date").over(by_year))
    start = F.coalesce(F.date_add("__prev", 1), F.trunc("date", "year"))
    days = spans.select(
        F.explode(F.sequence(start, F.col("date"))).alias("day"),
        F.col("date").alias("next_date"), F.col("holiday_name").alias("next_holiday_name"),
    )
    near = cal.select(F.explode(F.array(*[
        F.struct(F.date_add("date", k).alias("day"), F.lit(k).alias("k")) for k in (-3, -1, 0, 1, 3)
    ])).alias("x")).select("x.*")
    dow = F.weekday("day")
    flag = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0))
    k = F.col("k")
    flags = near.groupBy("day").agg(
        flag(k == 0).alias("is_holiday"),
        flag(((k == -1) & (dow == 0)) | ((k == 1) & (dow == 4))).alias("is_bridge_day"),
        flag((k == -1) | ((k == -3) & (dow == 4))).alias("is_pre_holiday"),
        flag((k == 1) | ((k == 3) & (dow == 0))).alias("is_post_holiday"),
    )
    out = days.join(flags, "day", "left")
    names = ["is_holiday", "is_bridge_day", "is_pre_holiday", "is_post_holiday"]
    return out.select(
        "day", *[F.coalesce(n, F.lit(0)).alias(n) for n in names],
        F.datediff("next_date", "day").alias("days_until_next_holiday"), "next_date", "next_holiday_name",
    )


def _attach(df: DataFrame, cal: DataFrame, t: str, cols: list[str]) -> DataFrame:
    d = calendar_days(cal).select(F.col("day").alias("__day"), *cols)
    return df.join(F.broadcast(d), F.to_date(t) == F.col("__day"), "left").drop("__day")


def is_holiday(df, cal, t="ts"):
    return _attach(df, cal, t, ["is_holiday"])


def bridge_day(df, cal, t="ts"):
    return _attach(df, cal, t, ["is_bridge_day"])


def pre_post_holiday(df, cal, t="ts"):
    return _attach(df, cal, t, ["is_pre_holiday", "is_post_holiday"])


def days_until(df, cal, t="ts"):
    """The calendar must reach one year past the data."""
    return _attach(df, cal, t, ["days_until_next_holiday"])


def next_holiday(df, cal, t="ts"):
    return _attach(df, cal, t, ["next_date", "next_holiday_name"])


def calendar_features(df, cal, t="ts"):
    """All flags with one join."""
    return _attach(df, cal, t, ["is_holiday", "is_bridge_day", "is_pre_holiday", "is_post_holiday", "days_until_next_holiday"])

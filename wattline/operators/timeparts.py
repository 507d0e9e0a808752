"""Date and time columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.ordered import col

# Labels of periods, in calendar order.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December"]
SEASONS = ["Summer", "Autumn", "Winter", "Spring"]
FIXED_HOLIDAY_MMDD = [101, 421, 501, 907, 1012, 1102, 1115, 1120, 1225]

TEMPORAL = {
    "hour": lambda t: F.hour(t),
    "day_of_week": lambda t: F.weekday(t),
    "day_of_month": lambda t: F.dayofmonth(t),
    "month": lambda t: F.month(t),
    "quarter": lambda t: F.quarter(t),
    "year": lambda t: F.year(t),
    "is_weekend": lambda t: (F.weekday(t) >= 5).cast("int"),
    "is_business_day": lambda t: (F.weekday(t) < 5).cast("int"),
}


def localize(df: DataFrame, t: str, tz: str, source_tz: str | None = None) -> DataFrame:
    """Wall time in ``tz`` -> instant in UTC; with ``source_tz``, wall time to wall time."""
    if source_tz:
        return df.withColumn(t, F.convert_timezone(F.lit(source_tz), F.lit(tz), F.col(t)))
    return df.withColumn(t, F.convert_timezone(F.lit(tz), F.lit("UTC"), F.col(t)))


def shift_back(df: DataFrame, t: str, minutes: int) -> DataFrame:
    return df.withColumn(t, F.col(t) - F.make_dt_interval(mins=F.lit(minutes)))


def temporal_features(df: DataFrame, t: str, features: Sequence[str] | None = None) -> DataFrame:
    return df.withColumns({f: TEMPORAL[f](F.col(t)) for f in (features or TEMPORAL)})


def season_number(t: Column) -> Column:
    return (F.floor((F.month(t) % 12) / 3) + 1).cast("int")


def _label(names: Sequence[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), i)


def season(df: DataFrame, t: str, names: bool = False) -> DataFrame:
    s = season_number(F.col(t))
    return df.withColumn("season", _label(SEASONS, s) if names else s)


def _pair(x: Column, period: float, name: str, sin="_sin", cos="_cos") -> dict[str, Column]:
    angle = 2 * F.pi() * x / period
    return {name + sin: F.sin(angle), name + cos: F.cos(angle)}


def cyclical_time(df: DataFrame, t: str) -> DataFrame:
    return df.withColumns({
        **_pair(F.hour(t), 24, "hour"), **_pair(F.weekday(t), 7, "day_of_week"), **_pair(F.month(t) - 1, 12, "month"),
    })


def cyclical(df: DataFrame, periods: Mapping[str, float], keep: bool = True, sin: str = "_sin", cos: str = "_cos") -> DataFrame:
    new: dict[str, Column] = {}
    for c, p in periods.items():
        if p <= 0:
            raise ValueError(f"period of {c!r} must be positive")
        new.update(_pair(F.col(c), p, c, sin, cos))
    out = df.withColumns(new)
    return out if keep else out.drop(*periods)


def period_of_day(t: str | Column, n: int = 48) -> Column:
    minutes = F.hour(col(t)) * 60 + F.minute(col(t))
    return F.floor(minutes / (1440 // n)).cast("int")


def period_features(df: DataFrame, t: str) -> DataFrame:
    """Regressors of the per-period models; the month angle is month/12 here."""
    t_ = F.col(t)
    return df.withColumns({
        "dayofweek": F.weekday(t_), "day": F.dayofmonth(t_), "month": F.month(t_), "quarter": F.quarter(t_),
        "is_weekend": (F.weekday(t_) >= 5).cast("int"),
        **_pair(F.month(t_), 12, "month"), **_pair(F.weekday(t_), 7, "dow"),
    })


def _mmdd(t: Column) -> Column:
    return F.month(t) * 100 + F.dayofmonth(t)


def period_label(t: str | Column, kind: str) -> Column:
    t = col(t)
    if kind == "weekday":
        return _label(WEEKDAYS, F.weekday(t) + 1)
    if kind == "season":
        return _label(SEASONS, season_number(t))
    if kind == "hour":
        return F.hour(t).cast("string")
    if kind == "month":
        return _label(MONTHS, F.month(t))
    if kind == "quarter":
        return F.concat(F.lit("Q"), F.quarter(t))
    if kind == "day_type":
        return F.when(F.weekday(t) >= 5, "Weekend").otherwise("Weekday")
    if kind == "holiday_proximity":
        d = F.to_date(t)
        return (
            F.when(_mmdd(d).isin(FIXED_HOLIDAY_MMDD), "Holiday")
            .when(_mmdd(F.date_add(d, 1)).isin(FIXED_HOLIDAY_MMDD), "Pre-Holiday")
            .when(_mmdd(F.date_sub(d, 1)).isin(FIXED_HOLIDAY_MMDD), "Post-Holiday")
            .otherwise("Regular")
        )
    raise ValueError(f"unknown period kind {kind!r}")


PERIOD_KINDS = ["weekday", "season", "hour", "month", "quarter", "day_type", "holiday_proximity"]


def date_range(spark: SparkSession, start, end) -> DataFrame:
    one = spark.range(1).select(F.lit(str(start)).cast("date").alias("a"), F.lit(str(end)).cast("date").alias("b"))
    return one.select(F.explode(F.sequence("a", "b")).alias("date"))

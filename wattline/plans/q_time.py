"""Date parts and the holiday calendar."""

from pyspark.sql import functions as F

from wattline.operators import holidays as C
from wattline.operators import timeparts as D
from wattline.plans.base import query
from wattline.plans.ctes import define
from wattline.sources import tables as tb

query("d01_localize", "SELECT area, ts + INTERVAL 3 HOUR AS ts FROM series", use="series")(
    lambda s, r: D.localize(tb.series(s, r).select("area", "ts"), "ts", "America/Sao_Paulo").select("area", F.col("ts").cast("timestamp_ntz").alias("ts")))
query("d02_shift_back", "SELECT area, ts - INTERVAL 30 MINUTE AS ts, load FROM series", use="series", rd="load")(
    lambda s, r: D.shift_back(tb.series(s, r), "ts", 30))
query("d03_temporal", "SELECT area, ts, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS day_of_week, day(ts)::INTEGER AS day_of_month, month(ts)::INTEGER AS month, quarter(ts)::INTEGER AS quarter, year(ts)::INTEGER AS year, (isodow(ts) > 5)::INTEGER AS is_weekend, (isodow(ts) <= 5)::INTEGER AS is_business_day FROM series", use="series")(
    lambda s, r: D.temporal_features(tb.series(s, r).drop("load"), "ts"))
query("d04_season", "SELECT area, ts, load, (floor((month(ts) % 12) / 3) + 1)::INTEGER AS season FROM daily", use="daily", rd="load")(
    lambda s, r: D.season(tb.daily(s, r), "ts"))
query("d05_cyclical_time", "SELECT area, ts, sin(2*pi()*hour(ts)/24) AS hour_sin, cos(2*pi()*hour(ts)/24) AS hour_cos, sin(2*pi()*(isodow(ts)-1)/7) AS day_of_week_sin, cos(2*pi()*(isodow(ts)-1)/7) AS day_of_week_cos, sin(2*pi()*(month(ts)-1)/12) AS month_sin, cos(2*pi()*(month(ts)-1)/12) AS month_cos FROM series",
      use="series", rd="hour_sin hour_cos day_of_week_sin day_of_week_cos month_sin month_cos")(
    lambda s, r: D.cyclical_time(tb.series(s, r).drop("load"), "ts"))
query("d06_cyclical", "SELECT p_partkey, sin(2*pi()*p_size/50) AS p_size_sin, cos(2*pi()*p_size/50) AS p_size_cos FROM part", rd="p_size_sin p_size_cos")(
    lambda s, r: D.cyclical(tb.load(s, r, "part").select("p_partkey", "p_size"), {"p_size": 50}, keep=False))
query("d07_period_of_day", "SELECT event_id, (hour(ts) * 2 + minute(ts) // 30)::INTEGER AS period FROM events")(
    lambda s, r: tb.load(s, r, "events").select("event_id", D.period_of_day("ts").alias("period")))
query("d08_period_features", "SELECT area, ts, (isodow(ts)-1)::INTEGER AS dayofweek, day(ts)::INTEGER AS day, month(ts)::INTEGER AS month, quarter(ts)::INTEGER AS quarter, (isodow(ts)>5)::INTEGER AS is_weekend, sin(2*pi()*month(ts)/12) AS month_sin, cos(2*pi()*month(ts)/12) AS month_cos, sin(2*pi()*(isodow(ts)-1)/7) AS dow_sin, cos(2*pi()*(isodow(ts)-1)/7) AS dow_cos FROM daily",
      use="daily", rd="month_sin month_cos dow_sin dow_cos")(
    lambda s, r: D.period_features(tb.daily(s, r).drop("load"), "ts"))

HP = """CASE WHEN month(d)*100+day(d) IN (101,421,501,907,1012,1102,1115,1120,1225) THEN 'Holiday'
 WHEN month(d+1)*100+day(d+1) IN (101,421,501,907,1012,1102,1115,1120,1225) THEN 'Pre-Holiday'
 WHEN month(d-1)*100+day(d-1) IN (101,421,501,907,1012,1102,1115,1120,1225) THEN 'Post-Holiday' ELSE 'Regular' END"""
LABEL_SQL = {
    "weekday": "dayname(d)", "season": "['Summer','Autumn','Winter','Spring'][((month(d) % 12) // 3) + 1]", "month": "monthname(d)",
    "quarter": "'Q' || quarter(d)", "day_type": "CASE WHEN isodow(d) > 5 THEN 'Weekend' ELSE 'Weekday' END", "holiday_proximity": HP,
    "hour": "hour(ts)::VARCHAR",
}
query("d09_period_label", "SELECT o_orderkey, " + ", ".join(f"{e} AS {k}" for k, e in LABEL_SQL.items()) + " FROM (SELECT o_orderkey, o_orderdate AS ts, o_orderdate::DATE AS d FROM orders)")(
    lambda s, r: tb.load(s, r, "orders").select("o_orderkey", *[D.period_label("o_orderdate", k).alias(k) for k in LABEL_SQL]))


@query("d10_date_range", "SELECT g.d::DATE AS date, count(o_orderkey) AS n FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS d) g LEFT JOIN orders ON o_orderdate = g.d GROUP BY 1")
def d10(spark, root):
    o = tb.load(spark, root, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return D.date_range(spark, "1995-01-01", "2001-12-31").join(o, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n"))


# --- calendar -------------------------------------------------------------------
define("easter", "", """
SELECT y, make_date(y::BIGINT, n // 31, n % 31 + 1) AS e FROM (SELECT *, h + l - 7 * m + 114 AS n FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM (
 SELECT *, (32 + 2 * e4 + 2 * (c // 4) - h - c % 4) % 7 AS l FROM (SELECT *, (19 * a + b - d4 - g + 15) % 30 AS h FROM (
 SELECT *, (b - (b + 8) // 25 + 1) // 3 AS g FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c, (y // 100) // 4 AS d4, (y // 100) % 4 AS e4 FROM range(1995, 2004) t(y)))))))""")
define("hol", "easter", """
SELECT date, min(holiday_name) AS holiday_name FROM (
 SELECT make_date(y::BIGINT, m, d) AS date, nm AS holiday_name FROM easter,
  (VALUES (1,1,'Ano Novo'),(4,21,'Tiradentes'),(5,1,'Dia do Trabalho'),(9,7,'Independencia'),(10,12,'Nossa Senhora Aparecida'),(11,2,'Finados'),(11,15,'Proclamacao da Republica'),(11,20,'Consciencia Negra'),(12,25,'Natal')) f(m, d, nm)
 UNION ALL SELECT (e + k)::DATE, nm FROM easter, (VALUES (-47,'Carnaval'),(-2,'Sexta-feira Santa'),(60,'Corpus Christi')) f(k, nm)) GROUP BY 1""")


def _cal(s):
    return C.holiday_calendar(s, 1995, 2003)


def _days(s, r):
    return tb.daily(s, r)


@query("c01_holiday_orders", "SELECT date, holiday_name, count(o_orderkey) AS n FROM hol LEFT JOIN orders ON o_orderdate = date GROUP BY 1, 2", use="hol")
def c01(spark, root):
    o = tb.load(spark, root, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return _cal(spark).join(o, "date", "left").select("date", "holiday_name", F.coalesce("n", F.lit(0)).alias("n"))


EX = lambda k: f"EXISTS (SELECT 1 FROM hol WHERE date = ts::DATE {k})"
query("c02_is_holiday", f"SELECT area, ts, load, {EX('')}::INTEGER AS is_holiday FROM daily", use="daily hol", rd="load")(
    lambda s, r: C.is_holiday(_days(s, r), _cal(s)))
query("c03_bridge_day", f"SELECT area, ts, load, ((isodow(ts) = 1 AND {EX('+ 1')}) OR (isodow(ts) = 5 AND {EX('- 1')}))::INTEGER AS is_bridge_day FROM daily", use="daily hol", rd="load")(
    lambda s, r: C.bridge_day(_days(s, r), _cal(s)))
query("c04_pre_post_holiday", f"SELECT area, ts, load, ({EX('+ 1')} OR (isodow(ts) = 5 AND {EX('+ 3')}))::INTEGER AS is_pre_holiday, ({EX('- 1')} OR (isodow(ts) = 1 AND {EX('- 3')}))::INTEGER AS is_post_holiday FROM daily", use="daily hol", rd="load")(
    lambda s, r: C.pre_post_holiday(_days(s, r), _cal(s)))
query("c05_days_until", "SELECT area, ts, load, ((SELECT min(date) FROM hol WHERE date >= ts::DATE) - ts::DATE)::INTEGER AS days_until_next_holiday FROM daily", use="daily hol", rd="load")(
    lambda s, r: C.days_until(_days(s, r), _cal(s)))
query("c06_next_holiday", "SELECT d.area, d.ts, d.load, h.date AS next_date, h.holiday_name AS next_holiday_name FROM (SELECT *, ts::DATE AS dd FROM daily) d ASOF JOIN hol h ON d.dd <= h.date", use="daily hol", rd="load")(
    lambda s, r: C.next_holiday(_days(s, r), _cal(s)))

"""Scans, joins, reshaping."""

from pyspark.sql import functions as F

from wattline.functions.ordered import stable
from wattline.operators import joins as J
from wattline.operators import reshape as Z
from wattline.operators.impute import daily_mean
from wattline.operators.quality import day_stats
from wattline.plans.base import query
from wattline.plans.ctes import define
from wattline.sources import readers as R
from wattline.sources import tables as tb
from wattline.sources.tables import MODELS

AREAS = ["click", "error", "purchase", "signup", "view"]
define("temps", "exog series", """
SELECT s.area, s.ts, x.temperature AS temp_celsius FROM series s
JOIN exog x ON x.ts = date_trunc('day', s.ts) - INTERVAL 8766 DAY""")


def temps(spark, root):
    """A temperature per (area, ts): the shipped-quantity series 24 years earlier, by day."""
    x = tb.exogenous(spark, root).select(
        F.col("ts").alias("d"), F.col("temperature").alias("temp_celsius")
    )
    s = tb.series(spark, root).select("area", "ts")
    return s.join(x, F.date_sub(F.to_date("ts"), 8766) == F.to_date("d")).select("area", "ts", "temp_celsius")


def _stored(spark, df, name):
    p = R.scratch(spark, name)
    out = df.withColumns({"year": F.year("ts"), "month": F.month("ts")})
    R.write_table(out, p, ["year", "month", "area"])
    return p


@query("s01_scan_load", "SELECT area, ts, load FROM series WHERE area IN ('click', 'view') AND ts >= '2024-01-05' AND ts < '2024-01-21'", use="series", rd="load")
def s01(spark, root):
    p = _stored(spark, tb.series(spark, root), "load")
    return R.scan_load(spark, p, ["click", "view"], "2024-01-05", "2024-01-20").select("area", "ts", "load")


@query("s02_scan_temperature", "SELECT area, ts, temp_celsius, 'D+1' AS source FROM temps WHERE area = 'click' AND ts >= '2024-01-05' AND ts < '2024-01-11'", use="temps", rd="temp_celsius")
def s02(spark, root):
    p = _stored(spark, temps(spark, root), "temp")
    return R.scan_temperature(spark, p, ["click"], "2024-01-05", "2024-01-10", 1).select("area", "ts", "temp_celsius", "source")


@query("s03_scan_heat_index", "SELECT area AS cod_area, ts AS timestamp, temp_celsius + 2 AS heat_index FROM temps WHERE area IN ('click', 'error')", use="temps", rd="heat_index")
def s03(spark, root):
    p = R.scratch(spark, "heat")
    temps(spark, root).select(F.col("area").alias("codigo_area"), F.col("ts").alias("data_hora"), (F.col("temp_celsius") + 2).alias("hi")).write.parquet(p)
    return R.scan_heat_index(spark, p, ["click", "error"])


@query("s04_scan_ecmwf", "SELECT area AS cod_area, ts AS timestamp, temp_celsius, 'ECMWF' AS source FROM temps WHERE area = 'view'", use="temps", rd="temp_celsius")
def s04(spark, root):
    p = R.scratch(spark, "ecmwf")
    temps(spark, root).select("area", F.col("ts").alias("datahora"), F.col("temp_celsius").alias("temp")).write.parquet(p)
    return R.scan_ecmwf(spark, p, ["view"])


@query("s05_scan_holidays", "SELECT DISTINCT o_orderdate::DATE AS date, 'busy' AS holiday_name, 'National' AS holiday_type, 1::INTEGER AS id_tipodiaespecial FROM orders WHERE o_totalprice > 499000 AND year(o_orderdate) IN (1996, 1997)")
def s05(spark, root):
    p = R.scratch(spark, "holidays")
    tb.load(spark, root, "orders").where("o_totalprice > 499000").select(
        F.to_date("o_orderdate").alias("data"), F.lit("busy").alias("nome"), F.lit("National").alias("tipo"), F.lit(1).alias("id_tipo")
    ).distinct().write.parquet(p)
    return R.scan_holidays(spark, p, [1996, 1997])


@query("s06_standardize", "SELECT ts AS timestamp, event_type AS cod_area, value AS carga_mwh FROM events", rd="carga_mwh")
def s06(spark, root):
    e = tb.load(spark, root, "events").select(F.col("ts").alias("data_hora"), F.col("event_type").alias("codigo_area"), F.col("value").alias("carga"), "props")
    return R.standardize(e, R.LOAD_ALIASES, R.LOAD_COLUMNS)


@query("s07_scan_any_csv", "SELECT area, count(*) AS n, sum(load) AS total FROM series GROUP BY 1", use="series", rd="total", digits=2)
def s07(spark, root):
    p = R.scratch(spark, "csv")
    tb.series(spark, root).select("area", "load").write.option("header", "true").csv(p)
    return R.scan_any(spark, p, "csv", "utf-8").groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.sum("load").alias("total"))


@query("s07_scan_any_latin1", "SELECT 'é' || area AS area, load FROM series", use="series", rd="load")
def s07_latin1(spark, root):
    p = R.scratch(spark, "csv")
    tb.series(spark, root).select(F.concat(F.lit("é"), "area").alias("area"), "load").write.option("header", "true").option("encoding", "ISO-8859-1").csv(p)
    return R.scan_any(spark, p, "csv")


@query("s08_table_round_trip", "SELECT area, ts, load FROM series", use="series", rd="load")
def s08(spark, root):
    p = R.scratch(spark, "table")
    R.write_table(tb.series(spark, root), p, ["area"])
    return R.read_table(spark, p).select("area", "ts", "load")


@query("s09_write_forecasts", "SELECT area, model, horizon, count(*) AS n, sum(yhat) AS total FROM scored GROUP BY ALL", use="scored", rd="total", digits=2)
def s09(spark, root):
    p = R.scratch(spark, "fc")
    R.write_forecasts(tb.scored(spark, root).select("area", "model", "horizon", "yhat"), p, "json")
    df = spark.read.schema("area string, model string, horizon int, yhat double").json(p)
    return df.groupBy("area", "model", "horizon").agg(F.count(F.lit(1)).alias("n"), F.sum("yhat").alias("total"))


@query("s10_file_dates", "SELECT area, ts, strptime(substr(regexp_extract(strftime(ts, 'pred_%Y_%m_%d.parquet'), '([0-9_]+)', 1), 2), '%Y_%m_%d')::DATE AS file_date FROM series", use="series")
def s10(spark, root):
    return tb.series(spark, root).select("area", "ts", R.file_date(F.date_format("ts", "'pred_'yyyy_MM_dd'.parquet'")).alias("file_date"))


@query("s10_scan_dated_files", "SELECT area, ts, load, ts::DATE AS file_date FROM series WHERE ts::DATE BETWEEN (SELECT min(ts::DATE) + 1 FROM series) AND (SELECT max(ts::DATE) - 1 FROM series)", use="series", rd="load")
def s10_scan(spark, root):
    p = R.scratch(spark, "dated")
    d = stable(tb.series(spark, root))
    days = [r[0] for r in d.select(F.to_date("ts").alias("day")).distinct().orderBy("day").collect()]  # one file per day of the series
    for day in days:
        d.where(F.to_date("ts") == F.lit(day)).write.parquet(f"{p}/pred_{day:%Y_%m_%d}.parquet")
    return R.scan_dated_files(spark, p, str(days[1]), str(days[-2])).select("area", "ts", "load", "file_date")


@query("s11_append_importance", "SELECT p_brand AS feature, avg(p_retailprice) AS score, 'tree' AS type, p_type AS model_id, TIMESTAMP '2024-01-01' AS timestamp FROM part GROUP BY ALL", rd="score")
def s11(spark, root):
    p = R.scratch(spark, "importance")
    g = tb.load(spark, root, "part").groupBy(F.col("p_brand").alias("feature"), F.col("p_type").alias("model_id")).agg(F.avg("p_retailprice").alias("score"))
    R.append_importance(g.withColumns({"type": F.lit("tree"), "timestamp": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")}), p)
    return R.read_table(spark, p)


@query("j01_join_load_temp", "SELECT ts, area, load, temp_celsius FROM series LEFT JOIN temps USING (ts, area)", use="series temps", rd="load temp_celsius")
def j01(spark, root):
    return J.join_load_temp(tb.series(spark, root), temps(spark, root))


HOL_SQL = "SELECT o_orderdate::DATE AS date, 'busy' AS holiday_name FROM orders WHERE o_totalprice > 495000 GROUP BY 1"
define("busy", "", HOL_SQL)


def busy(spark, root):
    o = tb.load(spark, root, "orders").where("o_totalprice > 495000")
    return o.select(F.to_date("o_orderdate").alias("date"), F.lit("busy").alias("holiday_name")).distinct()


@query("j02_join_holidays", "SELECT area, ts, load, holiday_name FROM daily LEFT JOIN busy ON date = ts::DATE", use="daily busy", rd="load")
def j02(spark, root):
    return J.join_holidays(tb.daily(spark, root), busy(spark, root))


@query("j03_join_all", "SELECT s.ts, s.area, s.load, t.temp_celsius, t.temp_celsius + 1 AS temp_celsius_Dplus2, t.temp_celsius * 2 AS heat_index FROM series s LEFT JOIN temps t USING (ts, area)", use="series temps", rd="load temp_celsius temp_celsius_Dplus2 heat_index")
def j03(spark, root):
    t = temps(spark, root)
    d1 = t.withColumn("source", F.lit("D+1"))
    d2 = t.withColumn("temp_celsius", F.col("temp_celsius") + 1).withColumn("source", F.lit("D+2"))
    heat = t.select("ts", "area", (F.col("temp_celsius") * 2).alias("heat_index"))
    return J.join_all(tb.series(spark, root), [("D+1", d1), ("D+2", d2)], heat)


@query("j03_pivot_temperatures", "SELECT ts, area, temp_celsius AS temp_celsius_Dplus1, temp_celsius + 1 AS temp_celsius_Dplus2 FROM temps", use="temps", rd="temp_celsius_Dplus1 temp_celsius_Dplus2")
def j03b(spark, root):
    t = temps(spark, root)
    long = t.withColumn("source", F.lit("D+1")).unionByName(t.withColumn("temp_celsius", F.col("temp_celsius") + 1).withColumn("source", F.lit("D+2")))
    return J.pivot_temperatures(long, ["D+1", "D+2"])


@query("j04_merge_features", "SELECT area, ts, a.load AS load, b.load * 2 AS load2 FROM series a FULL JOIN (SELECT * FROM series WHERE load > 50) b USING (area, ts)", use="series", rd="load load2")
def j04(spark, root):
    s = tb.series(spark, root)
    b = s.where("load > 50").select("area", "ts", (F.col("load") * 2).alias("load2"))
    return J.merge_features([s, b])


@query("j05_attach_daily", """SELECT g.area, g.ts, g.load, coalesce(d.daily_mean, o.m) AS daily_mean FROM grid g
LEFT JOIN (SELECT area, ts::DATE AS day, avg(load) AS daily_mean FROM series WHERE extract('isodow' FROM ts) <> 3 GROUP BY 1, 2) d ON d.area = g.area AND d.day = g.ts::DATE
LEFT JOIN (SELECT area, avg(daily_mean) AS m FROM (SELECT area, ts::DATE AS day, avg(load) AS daily_mean FROM series WHERE extract('isodow' FROM ts) <> 3 GROUP BY 1, 2) GROUP BY 1) o ON o.area = g.area""", use="grid", rd="load daily_mean")
def j05(spark, root):
    d = daily_mean(tb.series(spark, root).where(F.weekday("ts") != 2))
    return J.attach_daily(tb.grid(spark, root), d)


@query("j06_align", "SELECT ts, area, horizon, model, yhat, y FROM scored", use="scored", rd="yhat y")
def j06(spark, root):
    return J.align(tb.forecasts(spark, root), tb.actuals(spark, root))


@query("j07_horizon_target", "SELECT area, ts, load, lead(load, 48) OVER (PARTITION BY area ORDER BY ts) AS target_h1 FROM filled", use="filled", rd="load target_h1")
def j07(spark, root):
    return J.horizon_target(tb.filled(spark, root), 1, 48, step=30)


@query("j07_horizon_target_rows", "SELECT area, ts, load, lead(load, 96) OVER (PARTITION BY area ORDER BY ts) AS target_h2 FROM series", use="series", rd="load target_h2")
def j07b(spark, root):
    return J.horizon_target(tb.series(spark, root), 2, 48)


@query("j07_horizon_target_by_time", "SELECT a.area, a.ts, a.load, b.load AS target_h1 FROM series a LEFT JOIN series b ON b.area = a.area AND b.ts = a.ts + INTERVAL 1 DAY", use="series", rd="load target_h1")
def j07c(spark, root):
    return J.horizon_target_by_time(tb.series(spark, root), 1)


@query("j08_model_pairs", "SELECT a.ts, a.area, a.horizon, a.model AS model_a, b.model AS model_b, a.yhat AS yhat_a, b.yhat AS yhat_b FROM scored a JOIN scored b ON a.ts = b.ts AND a.area = b.area AND a.horizon = b.horizon AND a.model < b.model", use="scored", rd="yhat_a yhat_b")
def j08(spark, root):
    return J.model_pairs(tb.scored(spark, root), MODELS)


@query("j09_join_baseline", "SELECT a.area, a.model, a.mae, b.mae AS baseline_mae FROM (SELECT area, model, avg(abs(y - yhat)) AS mae FROM scored GROUP BY 1, 2) a JOIN (SELECT area, model, avg(abs(y - yhat)) AS mae FROM scored WHERE horizon = 1 GROUP BY 1, 2) b USING (area, model)", use="scored", rd="mae baseline_mae")
def j09(spark, root):
    s = tb.scored(spark, root).withColumn("ae", F.abs(F.col("y") - F.col("yhat")))
    g = lambda d: d.groupBy("area", "model").agg(F.avg("ae").alias("mae"))
    return J.join_baseline(g(s), g(s.where("horizon = 1")), metrics=["mae"])


@query("j10_semi_join_days", "SELECT area, ts, load FROM series WHERE (area, ts::DATE) IN (SELECT (area, ts::DATE) FROM series GROUP BY area, ts::DATE HAVING count(*) >= 36)", use="series", rd="load")
def j10(spark, root):
    s = tb.series(spark, root)
    return J.semi_join_days(s, day_stats(s).where("records >= 36"))


@query("z01_sort_series", "SELECT area, ts, load FROM series ORDER BY area, ts", use="series", rd="load")
def z01(spark, root):
    return Z.sort_series(tb.series(spark, root))


@query("z02_top_k", "SELECT area, ts, load FROM series ORDER BY load DESC, ts, area LIMIT 25", use="series", rd="load")
def z02(spark, root):
    return J.top_k(tb.series(spark, root), [], [F.col("load").desc(), "ts", "area"], 25)


@query("z02_top_k_per_group", "SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 10", rd="l_extendedprice")
def z02b(spark, root):
    li = tb.load(spark, root, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return J.top_k(li, ["l_returnflag"], [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"], 10).drop("l_partkey")


@query("z03_last_rows", "SELECT area, ts, load FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY ts DESC) AS r FROM series) WHERE r <= 48", use="series", rd="load")
def z03(spark, root):
    return J.last_rows(tb.series(spark, root), ["area"], 48)


@query("z04_union_frames", "SELECT area, ts, load, NULL::DOUBLE AS temp_celsius FROM series UNION ALL SELECT area, ts, NULL, temp_celsius FROM temps", use="series temps", rd="load temp_celsius")
def z04(spark, root):
    return Z.union_frames([tb.series(spark, root), temps(spark, root)])


@query("z05_missing_keys", "SELECT area, ts FROM grid EXCEPT SELECT area, ts FROM series", use="grid")
def z05(spark, root):
    return Z.missing_keys(tb.grid(spark, root), tb.series(spark, root), ["area", "ts"])


@query("z06_common_keys", "SELECT area, ts FROM series WHERE load > 80 INTERSECT SELECT area, ts FROM temps WHERE temp_celsius > 25", use="series temps")
def z06(spark, root):
    return Z.common_keys(tb.series(spark, root).where("load > 80"), temps(spark, root).where("temp_celsius > 25"), ["area", "ts"])


@query("z07_to_wide", "SELECT area, ts, model, max(yhat) FILTER (horizon = 1) AS pred_h1, max(yhat) FILTER (horizon = 2) AS pred_h2, max(yhat) FILTER (horizon = 3) AS pred_h3 FROM scored GROUP BY 1, 2, 3", use="scored", rd="pred_h1 pred_h2 pred_h3")
def z07(spark, root):
    return Z.to_wide(tb.scored(spark, root), ["area", "ts", "model"], "horizon", [1, 2, 3], "yhat")


@query("z07_to_long", "SELECT area, ts, model, horizon, yhat FROM scored", use="scored", rd="yhat")
def z07b(spark, root):
    return Z.to_long(z07(spark, root), ["area", "ts", "model"]).where("yhat is not null")


@query("z08_math", "SELECT event_id, abs(value - 50) AS a, exp(-value / 100) AS e, ln(value + 1) AS l, pow(value, 0.5) AS p, sqrt(value) AS s, least(greatest(value, 5), 100) AS c, sin(value) AS si, cos(value) AS co FROM events", rd="a e l p s c si co")
def z08(spark, root):
    v = F.col("value")
    return tb.load(spark, root, "events").select(
        "event_id", F.abs(v - 50).alias("a"), F.exp(-v / 100).alias("e"), F.ln(v + 1).alias("l"), F.pow(v, F.lit(0.5)).alias("p"),
        F.sqrt(v).alias("s"), Z.clip(v, 5.0, 100.0).alias("c"), F.sin(v).alias("si"), F.cos(v).alias("co"))


@query("z09_text", "SELECT p_partkey, lower(p_brand) AS b, regexp_extract(p_brand, '([0-9]+)', 1) AS n, ends_with(p_name, 'bolt') AS is_bolt, starts_with(p_name, 'red') AS is_red FROM part")
def z09(spark, root):
    return tb.load(spark, root, "part").select(
        "p_partkey", F.lower("p_brand").alias("b"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("n"),
        F.endswith("p_name", F.lit("bolt")).alias("is_bolt"), F.startswith("p_name", F.lit("red")).alias("is_red"))


@query("z10_arrays", "SELECT o_custkey, list_contains(list_sort(list(DISTINCT o_orderstatus)), 'F') AS has_f, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0 AS all_fo FROM orders GROUP BY 1")
def z10(spark, root):
    g = tb.load(spark, root, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("st"))
    return g.select("o_custkey", F.array_contains("st", "F").alias("has_f"), F.forall("st", lambda x: x.isin("F", "O")).alias("all_fo"))

"""Validation, filters, quality reports, imputation, resampling."""

from pyspark.sql import functions as F

from wattline.operators import impute as I
from wattline.operators import quality as Q
from wattline.plans.base import query
from wattline.plans.ctes import define
from wattline.plans.q_source import temps
from wattline.sources import tables as tb

KNOWN = ["click", "purchase", "signup", "view"]
define("capped", "filled", "SELECT area, ts, CASE WHEN load > 400 OR hour(ts) = 13 THEN NULL ELSE load END AS load FROM filled")


def capped(s, r):
    """The filled series with a gap at every 13:xx and at high values."""
    return tb.filled(s, r).withColumn("load", F.when((F.col("load") > 400) | (F.hour("ts") == 13), F.lit(None)).otherwise(F.col("load")))


DAYS = "SELECT area, ts::DATE AS day, count(*) AS records, avg((load IS NULL)::INTEGER) AS missing_pct FROM grid GROUP BY 1, 2"
query("q01_complete_days", f"SELECT area, ts, load FROM grid WHERE (area, ts::DATE) IN (SELECT (area, day) FROM ({DAYS}) WHERE records = 48 AND missing_pct <= 0.25)", use="grid", rd="load")(
    lambda s, r: Q.complete_days(tb.grid(s, r), value_cols=["load"], max_missing_pct=0.25))
query("q02_expected_records", """SELECT area, gap AS gap_minutes, CASE WHEN gap BETWEEN 25 AND 35 THEN 48 WHEN gap BETWEEN 55 AND 65 THEN 24 ELSE 48 END AS expected FROM (
 SELECT area, gap, row_number() OVER (PARTITION BY area ORDER BY count(*) DESC, gap) AS r FROM (
  SELECT area, (epoch(ts - lag(ts) OVER (PARTITION BY area ORDER BY ts)) / 60)::DOUBLE AS gap FROM series) WHERE gap IS NOT NULL GROUP BY 1, 2) WHERE r = 1""", use="series", rd="gap_minutes")(
    lambda s, r: Q.expected_records(tb.series(s, r)))
query("q03_filter_report", f"""SELECT count(*) AS total_days, count(*) FILTER (reason IS NULL) AS complete_days, count(*) FILTER (reason IS NOT NULL) AS incomplete_days,
 count(*) FILTER (reason = 'i') AS insufficient_records, count(*) FILTER (reason = 'e') AS excess_records, count(*) FILTER (reason = 'm') AS too_many_missing,
 list_sort(list(DISTINCT area) FILTER (reason IS NOT NULL)) AS affected_areas, count(*) FILTER (reason IS NULL) / count(*)::DOUBLE AS retention_rate
 FROM (SELECT *, CASE WHEN records < 48 THEN 'i' WHEN records > 48 THEN 'e' WHEN missing_pct > 0.25 THEN 'm' END AS reason FROM ({DAYS}))""", use="grid", rd="retention_rate")(
    lambda s, r: Q.filter_report(tb.grid(s, r), value_cols=["load"], max_missing_pct=0.25))
query("q04_dedup", "SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1", rd="value")(
    lambda s, r: Q.dedup(tb.load(s, r, "events").drop("props"), ["user_id", "event_type"], ["ts", "event_id"]))
query("q04_dedup_report", "SELECT sum(n)::BIGINT AS rows, count(*) AS kept, sum(n - 1)::BIGINT AS removed FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type)")(
    lambda s, r: Q.dedup_report(tb.load(s, r, "events"), ["user_id", "event_type"]))
query("q05_find_duplicates", "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT (o_custkey, o_orderdate) FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)")(
    lambda s, r: Q.find_duplicates(tb.load(s, r, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate"]))
query("q06_check_sorted", "SELECT o_orderstatus, count(*) AS rows, count(*) FILTER (p > o_orderdate) AS out_of_order, count(*) FILTER (p > o_orderdate) = 0 AS is_sorted FROM (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS p FROM orders) GROUP BY 1")(
    lambda s, r: Q.check_sorted(tb.load(s, r, "orders"), ["o_orderstatus"], "o_orderdate", "o_orderkey"))


@query("q07_validate_load", "SELECT area, ts, load, array_to_string(list_filter([CASE WHEN area NOT IN ('click','purchase','signup','view') THEN 'area' END, CASE WHEN NOT load > 5 THEN 'load' END], lambda x: x IS NOT NULL), ',') AS errors FROM series", use="series", rd="load")
def q07(s, r):
    d = tb.series(s, r).withColumn("load", F.col("load") - 5)
    return Q.flag_rules(d, Q.load_rules(KNOWN)).select("area", "ts", (F.col("load") + 5).alias("load"), F.concat_ws(",", "errors").alias("errors"))


query("q07_valid_rows", "SELECT area, ts, load FROM series WHERE area IN ('click','purchase','signup','view') AND load > 0", use="series", rd="load")(
    lambda s, r: Q.validate(tb.series(s, r), Q.load_rules(KNOWN))[0])
query("q08_validate_temperature", "SELECT ts, area, temp_celsius * 2 AS temp_celsius, 'D+1' AS source FROM temps WHERE area IN ('click','purchase','signup','view') AND temp_celsius * 2 BETWEEN -10 AND 50", use="temps", rd="temp_celsius")(
    lambda s, r: Q.validate(temps(s, r).withColumns({"temp_celsius": F.col("temp_celsius") * 2, "source": F.lit("D+1")}), Q.temperature_rules(KNOWN))[0])
query("q09_validate_heat", "SELECT ts, area, temp_celsius * 2 AS heat_index FROM temps WHERE NOT (area IN ('click','purchase','signup','view') AND temp_celsius * 2 BETWEEN 15 AND 55)", use="temps", rd="heat_index")(
    lambda s, r: Q.validate(temps(s, r).select("ts", "area", (F.col("temp_celsius") * 2).alias("heat_index")), Q.heat_rules(KNOWN))[1].drop("errors"))


@query("q10_validate_holidays", "SELECT o_orderdate::DATE AS date, min(o_custkey % 12) AS id_tipodiaespecial FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 HAVING min(o_custkey % 12) BETWEEN 0 AND 10 AND bool_and(c_mktsegment <> 'MACHINERY')")
def q10(s, r):
    o = tb.load(s, r, "orders").join(tb.load(s, r, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    h = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.min(F.col("o_custkey") % 12).alias("id_tipodiaespecial"), F.lit("National").alias("holiday_type"),
        F.collect_set("c_mktsegment").alias("affected_areas"))
    return Q.validate(h, Q.holiday_rules(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]))[0].select("date", "id_tipodiaespecial")


query("q11_validation_report", "SELECT count(*) AS total, count(*) FILTER (NOT (area IN ('click','purchase','signup','view') AND load > 20)) AS invalid, count(*) FILTER (area NOT IN ('click','purchase','signup','view')) AS errors_area, count(*) FILTER (NOT load > 20) AS errors_load FROM series", use="series")(
    lambda s, r: Q.validation_report(tb.series(s, r), {"area": F.col("area").isin(KNOWN), "load": F.col("load") > 20})[0])
query("q12_find_gaps", "SELECT area, ts FROM grid WHERE load IS NULL", use="grid")(
    lambda s, r: Q.find_gaps(tb.series(s, r)))
query("q13_null_counts", "SELECT 'load' AS feature, count(*) AS rows, count(*) FILTER (load IS NULL) AS nulls, count(*) FILTER (load IS NULL) / count(*)::DOUBLE AS null_pct FROM grid", use="grid", rd="null_pct")(
    lambda s, r: Q.validate_features(tb.grid(s, r), ["area", "ts", "load"], ["area", "ts"])[1])
query("q14_check_keys", "SELECT sum(n)::BIGINT AS rows, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS duplicated_keys, max(n) = 1 AS is_unique FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")(
    lambda s, r: Q.check_keys(tb.load(s, r, "lineitem"), ["l_orderkey", "l_linenumber"]))
query("q15_profile", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS count, count(*) FILTER ({c} IS NULL) AS nulls, count(*) FILTER ({c} IS NULL) / count(*)::DOUBLE AS null_pct, avg({c}) AS mean, stddev_samp({c}) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")),
      rd="null_pct mean std min max")(
    lambda s, r: Q.profile(tb.load(s, r, "lineitem"), ["l_quantity", "l_discount", "l_tax"]))
query("q16_sparse_columns", " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL OR {c} = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS sparse_share, avg(CASE WHEN {c} IS NULL OR {c} = 0 THEN 1.0 ELSE 0.0 END) >= 0.1 AS is_sparse FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")), rd="sparse_share")(
    lambda s, r: Q.sparse_columns(tb.load(s, r, "lineitem"), ["l_quantity", "l_discount", "l_tax"], 0.1))
query("q17_duplicate_columns", "SELECT 'qty_copy' AS feature, 'l_quantity' AS same_as FROM lineitem HAVING count(*) FILTER (l_quantity IS NULL) = 0")(
    lambda s, r: Q.duplicate_columns(tb.load(s, r, "lineitem").withColumn("qty_copy", F.col("l_quantity")), ["l_quantity", "l_tax", "qty_copy", "l_discount"], ["l_orderkey", "l_linenumber"]))
query("q18_series_fitness", """SELECT area, count(*) AS n_observations, count(*) FILTER (load IS NULL) AS n_missing, stddev_samp(load) > 0 AS has_variance, count(*) FILTER (load < 0) AS n_negative,
 CASE WHEN count(*) FILTER (load IS NULL) > 0 THEN 'missing' ELSE '' END AS issues, count(*) FILTER (load IS NULL) = 0 AS is_valid FROM dgrid GROUP BY 1""", use="dgrid")(
    lambda s, r: Q.series_fitness(tb.daily_grid(s, r)))
U = lambda seed, keys: f"(('0x' || substr(md5(concat_ws('|', '{seed}', {keys})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
query("q19_inject_missing", f"SELECT event_id, CASE WHEN {U(42, chr(39) + 'value' + chr(39) + ', event_id::VARCHAR')} < 0.2 THEN NULL ELSE value END AS value FROM events", rd="value")(
    lambda s, r: Q.inject_missing(tb.load(s, r, "events").select("event_id", "value"), ["value"], 0.2, ["event_id"]))
query("q20_inject_outliers", f"""SELECT event_id, event_type, CASE WHEN {U(42, "'value', event_id::VARCHAR")} < 0.1 THEN m + CASE WHEN {U(43, "'value', event_id::VARCHAR")} < 0.5 THEN -1 ELSE 1 END * 5 * sd ELSE value END AS value
 FROM events JOIN (SELECT event_type, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY 1) USING (event_type)""", rd="value")(
    lambda s, r: Q.inject_outliers(tb.load(s, r, "events").select("event_id", "event_type", "value"), ["value"], 0.1, 5.0, ["event_id"], ["event_type"]))
query("q21_inject_gaps", f"""SELECT area, ts, load FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY ts) AS rn FROM filled) f WHERE NOT EXISTS (
 SELECT 1 FROM (SELECT area, floor({U(42, "area, g::VARCHAR")} * (n - 23))::INTEGER + 1 AS st FROM (SELECT area, count(*) AS n FROM filled GROUP BY 1), range(1, 6) t(g)) s WHERE s.area = f.area AND f.rn BETWEEN s.st AND s.st + 23)""", use="filled", rd="load")(
    lambda s, r: Q.inject_gaps(tb.filled(s, r), gap_size=24, num_gaps=5))
query("q22_inject_type_errors", f"SELECT event_id, CASE WHEN {U(42, chr(39) + 'value' + chr(39) + ', event_id::VARCHAR')} < 0.05 THEN NULL ELSE value END AS value FROM events", rd="value")(
    lambda s, r: Q.recover_types(Q.inject_type_errors(tb.load(s, r, "events").select("event_id", "value"), "value", 0.05, ["event_id"]), "value"))


@query("q23_drop_sparse_models", "SELECT model, count(*) AS n FROM fcrows WHERE model IN (SELECT model FROM (SELECT model, horizon, avg((yhat IS NULL)::INTEGER) AS m FROM fcrows GROUP BY 1, 2) GROUP BY 1 HAVING avg(m) <= 0.01) GROUP BY 1", use="fcrows")
def q23(s, r):
    return Q.drop_sparse_models(tb.forecasts(s, r), 0.01).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


W = "(PARTITION BY area ORDER BY ts {})"
query("i01_ffill", f"SELECT area, ts, last_value(load IGNORE NULLS) OVER {W.format('')} AS load FROM capped", use="capped", rd="load")(
    lambda s, r: I.ffill(capped(s, r), "load"))
query("i01_ffill_limit", f"SELECT area, ts, last_value(load IGNORE NULLS) OVER {W.format('ROWS BETWEEN 1 PRECEDING AND CURRENT ROW')} AS load FROM capped", use="capped", rd="load")(
    lambda s, r: I.ffill(capped(s, r), "load", limit=1))
query("i02_bfill", f"SELECT area, ts, first_value(load IGNORE NULLS) OVER {W.format('ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS load FROM capped", use="capped", rd="load")(
    lambda s, r: I.bfill(capped(s, r), "load"))
query("i02_bfill_limit", f"SELECT area, ts, first_value(load IGNORE NULLS) OVER {W.format('ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING')} AS load FROM capped", use="capped", rd="load")(
    lambda s, r: I.bfill(capped(s, r), "load", limit=2, step=30))
NB = """SELECT area, ts, load, x,
 last_value(CASE WHEN load IS NOT NULL THEN x END IGNORE NULLS) OVER a AS ax, last_value(load IGNORE NULLS) OVER a AS av,
 first_value(CASE WHEN load IS NOT NULL THEN x END IGNORE NULLS) OVER z AS zx, first_value(load IGNORE NULLS) OVER z AS zv
 FROM (SELECT *, {x} AS x FROM {src})
 WINDOW a AS (PARTITION BY area ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY area ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""
ROWX = "(row_number() OVER (PARTITION BY area ORDER BY ts))::DOUBLE"
LIN = "coalesce(load, CASE WHEN av IS NOT NULL AND zv IS NOT NULL THEN av + (zv - av) * (x - ax) / (zx - ax) ELSE {} END)"
query("i03_interpolate_linear", f"SELECT area, ts, {LIN.format('av')} AS load FROM ({NB.format(x=ROWX, src='capped')})", use="capped", rd="load")(
    lambda s, r: I.interpolate(capped(s, r), "load"))
query("i03_interpolate_time", f"SELECT area, ts, {LIN.format('av')} AS load FROM ({NB.format(x='epoch(ts)', src='(SELECT * FROM capped WHERE minute(ts) = 0 OR load > 60)')})", use="capped", rd="load")(
    lambda s, r: I.interpolate(capped(s, r).where((F.minute("ts") == 0) | (F.col("load") > 60)), "load", method="time"))
query("i03_interpolate_nearest", f"SELECT area, ts, coalesce(load, CASE WHEN av IS NOT NULL AND zv IS NOT NULL THEN CASE WHEN x - ax <= zx - x THEN av ELSE zv END END) AS load FROM ({NB.format(x=ROWX, src='capped')})", use="capped", rd="load")(
    lambda s, r: I.interpolate(capped(s, r), "load", method="nearest"))
query("i03_interpolate_zero", f"SELECT area, ts, coalesce(load, CASE WHEN zv IS NOT NULL THEN av END) AS load FROM ({NB.format(x=ROWX, src='capped')})", use="capped", rd="load")(
    lambda s, r: I.interpolate(capped(s, r), "load", method="zero"))
query("i04_lag_fill", "SELECT area, ts, coalesce(f, lag(f, 96) OVER w) AS load FROM (SELECT area, ts, coalesce(load, lag(load, 48) OVER w) AS f FROM grid WINDOW w AS (PARTITION BY area ORDER BY ts)) WINDOW w AS (PARTITION BY area ORDER BY ts)", use="grid", rd="load")(
    lambda s, r: I.lag_fill(tb.grid(s, r), "load", step=30))
query("i05_triple_pass", """SELECT area, ts, coalesce(load, (last_value(load IGNORE NULLS) OVER a + first_value(load IGNORE NULLS) OVER z) / 2, last_value(load IGNORE NULLS) OVER a) AS load FROM (
 SELECT area, ts, coalesce(last_value(load IGNORE NULLS) OVER d, first_value(load IGNORE NULLS) OVER e) AS load FROM (SELECT area, ts, CASE WHEN day(ts) % 5 = 0 THEN NULL ELSE load END AS load FROM capped)
 WINDOW d AS (PARTITION BY area, ts::DATE ORDER BY ts), e AS (PARTITION BY area, ts::DATE ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 WINDOW a AS (PARTITION BY area ORDER BY ts), z AS (PARTITION BY area ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", use="capped", rd="load")(
    lambda s, r: I.triple_pass(capped(s, r).withColumn("load", F.when(F.dayofmonth("ts") % 5 == 0, F.lit(None)).otherwise(F.col("load"))), "load"))
query("i06_impute_chain", f"SELECT area, ts, first_value(load IGNORE NULLS) OVER {W.format('ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS load FROM (SELECT area, ts, coalesce(f, lag(f, 96) OVER w) AS load FROM (SELECT area, ts, coalesce(load, lag(load, 48) OVER w) AS f FROM grid WINDOW w AS (PARTITION BY area ORDER BY ts)) WINDOW w AS (PARTITION BY area ORDER BY ts))", use="grid", rd="load")(
    lambda s, r: I.impute_chain(tb.grid(s, r), "load", [lambda d, c: I.lag_fill(d, c, step=30), I.bfill]))
query("i07_resample_30min", "SELECT area, ts, load FROM filled", use="filled", rd="load")(
    lambda s, r: I.resample_30min(tb.series(s, r)))
for _a, _e in {"mean": "avg(load)", "sum": "sum(load)", "first": "arg_min(load, ts)", "last": "arg_max(load, ts)", "min": "min(load)", "max": "max(load)"}.items():
    query(f"i08_resample_hourly_{_a}", f"SELECT g.area, g.ts, h.load FROM (SELECT area, unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS ts FROM series GROUP BY 1) g LEFT JOIN (SELECT area, date_trunc('hour', ts) AS ts, {_e} AS load FROM series GROUP BY 1, 2) h USING (area, ts)", use="series", rd="load")(
        lambda s, r, a=_a: I.resample_hourly(tb.series(s, r), agg=a))
query("i09_daily_mean", "SELECT area, ts::DATE AS day, avg(load) AS daily_mean FROM series GROUP BY 1, 2", use="series", rd="daily_mean")(
    lambda s, r: I.daily_mean(tb.series(s, r)))
query("i10_fill_both", f"SELECT area, ts, {LIN.format('coalesce(av, zv)')} AS load FROM ({NB.format(x=ROWX, src='(SELECT area, ts, CASE WHEN day(ts) IN (1, 30) THEN NULL ELSE load END AS load FROM capped)')})", use="capped", rd="load")(
    lambda s, r: I.fill_both(capped(s, r).withColumn("load", F.when(F.dayofmonth("ts").isin(1, 30), F.lit(None)).otherwise(F.col("load"))), "load"))
define("med", "filled", "SELECT area, median(load) AS med FROM filled GROUP BY 1")
define("mad", "med", "SELECT area, med, median(abs(load - med)) AS mad FROM filled JOIN med USING (area) GROUP BY 1, 2")
WINS = """SELECT f.area, f.ts, CASE WHEN f.o THEN greatest(least(f.load, q.hi), q.lo) ELSE f.load END AS load FROM (SELECT area, ts, load, coalesce(mad > 0 AND 0.6745 * abs(load - med) / mad > {z}, false) AS o FROM {src} JOIN {mad} USING (area)) f
 LEFT JOIN (SELECT area, quantile_cont(load, 0.05) AS lo, quantile_cont(load, 0.95) AS hi FROM {src} JOIN {mad} USING (area) WHERE NOT coalesce(mad > 0 AND 0.6745 * abs(load - med) / mad > {z}, false) GROUP BY 1) q USING (area)"""
query("i11_winsorize", WINS.format(z=2.0, src="filled", mad="mad"), use="filled mad", rd="load")(
    lambda s, r: I.winsorize(tb.filled(s, r), "load", z=2.0))
query("i12_fill_limited", f"""SELECT area, ts, coalesce(load, last_value(load IGNORE NULLS) OVER a, first_value(load IGNORE NULLS) OVER z) AS load FROM (
 SELECT area, ts, coalesce(load, CASE WHEN x - coalesce(ax, zx) <= 1 THEN CASE WHEN av IS NOT NULL AND zv IS NOT NULL THEN av + (zv - av) * (x - ax) / (zx - ax) ELSE av END END) AS load FROM ({NB.format(x=ROWX, src='capped')}))
 WINDOW a AS (PARTITION BY area ORDER BY ts), z AS (PARTITION BY area ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", use="capped", rd="load")(
    lambda s, r: I.fill_limited(capped(s, r), "load", limit=1))
define("dboth", "dgrid", f"SELECT area, ts, {LIN.format('coalesce(av, zv)')} AS load FROM ({NB.format(x=ROWX, src='dgrid')})")
define("dmed", "dboth", "SELECT area, median(load) AS med FROM dboth GROUP BY 1")
define("dmad", "dmed", "SELECT area, med, median(abs(load - med)) AS mad FROM dboth JOIN dmed USING (area) GROUP BY 1, 2")
query("i13_clean_series", WINS.format(z=3.5, src="dboth", mad="dmad"), use="dboth dmad", rd="load", digits=5)(
    lambda s, r: I.clean_series(tb.daily_grid(s, r), "load"))

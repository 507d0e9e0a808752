"""Training, profiles, intraday correction, streams."""

from pyspark.sql import functions as F

from wattline.functions.ordered import stable
from wattline.operators import boosting as B
from wattline.operators import intraday as I
from wattline.operators import profiles as P
from wattline.operators import training as T
from wattline.operators.folds import fold_rows
from wattline.operators.quality import load_rules
from wattline.plans.base import query
from wattline.plans.ctes import define
from wattline.plans.q_features import COLS, training_rows
from wattline.plans.q_hierarchy import PROP, E, every_fc
from wattline.plans.q_metrics import SC
from wattline.plans.q_quality import KNOWN
from wattline.sources import tables as tb
from wattline.sources.readers import scratch
from wattline.streaming import feeds as X
from wattline.streaming import keyed as K

query("k01_time_folds", """SELECT area, ts, load, greatest(b, 1) + k.k AS fold, CASE WHEN b = greatest(b, 1) + k.k THEN 'test' ELSE 'train' END AS role FROM (SELECT *, least(floor((rn - 1) / greatest(floor(n / 4.0::DOUBLE), 1)), 3)::INTEGER AS b FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY ts) AS rn, count(*) OVER (PARTITION BY area) AS n FROM series)), (SELECT unnest([0, 1, 2])::INTEGER AS k) k WHERE greatest(b, 1) + k.k <= 3""", use="series", rd="load")(
    lambda s, r: fold_rows(tb.series(s, r), 3))
TR = lambda s, r: training_rows(s, r)


@query("k03_predict_gbt")
def k03(s, r):
    d = TR(s, r)
    x = T.index_areas(d).transform(d)
    return T.predict_gbt(T.train_gbt(x, [*COLS, "area_index"], "target"), x, [*COLS, "area_index"], 1)


query("k03_predict_areas")(lambda s, r: (lambda d: T.predict_areas(T.train_areas(d, COLS, "target"), d, 1))(TR(s, r)))


@query("k05_predict_rf")
def k05(s, r):
    d = TR(s, r).drop("target")
    return T.predict_rf(T.train_rf(d, "load", ["load", "load_lag_1", "load_lag_7", "day_of_week", "month"], [1, 2], 1, tb.DAY), d)


query("k06_fit_daily_ar", """SELECT area, ts AS origin, horizon, n, greatest(b0 + b1 * last + b2 * week, 0) AS yhat FROM (
 SELECT area, horizon, n, (sy * d - 0) / n - b1 * ml - b2 * mw AS b0, b1, b2 FROM (SELECT *, 1 AS d, (syl * vww - syw * vlw) / (vll * vww - vlw * vlw) AS b1, (syw * vll - syl * vlw) / (vll * vww - vlw * vlw) AS b2 FROM (
  SELECT area, horizon, count(*) AS n, sum(y) AS sy, avg(last) AS ml, avg(week) AS mw, covar_pop(y, last) AS syl, covar_pop(y, week) AS syw, var_pop(last) AS vll, var_pop(week) AS vww, covar_pop(last, week) AS vlw FROM arx WHERE y IS NOT NULL AND week IS NOT NULL GROUP BY 1, 2)))
 JOIN (SELECT area, horizon, max(ts) AS ts, arg_max(last, ts) AS last, arg_max(week, ts) AS week FROM arx GROUP BY 1, 2) USING (area, horizon)""", use="arx", rd="yhat", digits=3)(
    lambda s, r: P.fit_daily_ar(tb.daily_filled(s, r), horizons=[1, 2]).select("area", "origin", "horizon", "n", "yhat"))
define("arx", "dfilled", " UNION ALL ".join(f"SELECT area, ts, {h} AS horizon, load AS last, lead(load, {h}) OVER w AS y, lag(load, {7 - h}) OVER w AS week FROM dfilled WINDOW w AS (PARTITION BY area ORDER BY ts)" for h in (1, 2)))
query("k07_fit_daily_hw")(lambda s, r: P.fit_daily_hw(tb.daily_filled(s, r)).select("area", "origin", "horizon", "yhat", "alpha", "beta", "gamma"))
query("k08_hw_intervals")(lambda s, r: P.hw_intervals(P.fit_daily_hw(tb.daily_filled(s, r))).select("area", "horizon", "yhat", "lo", "hi"))
query("k08_hw_components")(lambda s, r: P.hw_components(P.holt_winters(tb.daily_filled(s, r), ["area"])))
define("rat", "filled", "SELECT area, ts::DATE AS day, (hour(ts) * 2 + minute(ts) // 30)::INTEGER AS period, greatest(least(load / (avg(load) OVER (PARTITION BY area, ts::DATE) + 1e-8), 10), 0.01) AS ratio FROM filled")
RAT = lambda s, r: P.profile_ratios(tb.filled(s, r))
query("k09_train_profile_reg")(lambda s, r: P.train_profile_reg(RAT(s, r)).select("area", "period", "n", "sigma"))
query("k10_train_profile_hw")(lambda s, r: P.train_profile_hw(RAT(s, r)).select("area", "period", "n", "level", "trend", "multiplicative"))
query("k11_profile_bounds", "SELECT area, period, mean, sd, q25, q75, greatest(q25 - 2 * sd, lo) AS lower, least(q75 + 2 * sd, hi) AS upper FROM (SELECT area, period, avg(ratio) AS mean, stddev_samp(ratio) AS sd, quantile_cont(ratio, 0.25) AS q25, quantile_cont(ratio, 0.75) AS q75 FROM rat GROUP BY 1, 2) JOIN (SELECT area, min(ratio) AS lo, max(ratio) AS hi FROM rat GROUP BY 1) USING (area)", use="rat", rd="mean sd q25 q75 lower upper")(
    lambda s, r: P.profile_bounds(RAT(s, r)))
query("k12_profile_ratios", "SELECT * FROM rat", use="rat", rd="ratio")(RAT)
define("nrm", "rat", "SELECT area, day, period, ratio * 48 / sum(ratio) OVER (PARTITION BY area, day) AS ratio, sum(ratio) OVER (PARTITION BY area, day) AS original_sum FROM rat")
query("k13_normalize_profiles", "SELECT * FROM nrm", use="nrm", rd="ratio original_sum")(lambda s, r: P.normalize_profiles(RAT(s, r)))
query("k13_normalize_additive", "SELECT area, day, period, ratio + (48 - sum(ratio) OVER p) / count(*) OVER p AS ratio, sum(ratio) OVER p AS original_sum FROM rat WINDOW p AS (PARTITION BY area, day)", use="rat", rd="ratio original_sum")(
    lambda s, r: P.normalize_profiles(RAT(s, r), method="additive"))
query("k14_denormalize_profiles", "SELECT * FROM rat", use="rat", rd="ratio")(
    lambda s, r: P.denormalize_profiles(P.normalize_profiles(RAT(s, r)), P.normalize_profiles(RAT(s, r)).select("area", "day", "original_sum").distinct()).select("area", "day", "period", "ratio"))
query("k15_smooth_profiles", """SELECT area, day, period, s * sum(ratio) OVER p / sum(s) OVER p AS ratio FROM (SELECT a.area, a.day, a.period, a.ratio, sum(b.ratio * k.w) AS s FROM rat a, (SELECT k, exp(-0.5 * k * k) / sum(exp(-0.5 * k * k)) OVER () AS w FROM range(-4, 5) t(k)) k, rat b
 WHERE b.area = a.area AND b.day = a.day AND b.period = (a.period - k.k + 48) % 48 GROUP BY 1, 2, 3, 4) WINDOW p AS (PARTITION BY area, day)""", use="rat", rd="ratio")(
    lambda s, r: P.smooth_profiles(RAT(s, r)))
query("k16_validate_profiles", "SELECT area, count(*) AS days, sum(bad)::BIGINT AS out_of_range, count(*) FILTER (abs(s - 48) > 0.01) AS bad_sums FROM (SELECT area, day, count(*) FILTER (ratio < 0.2 OR ratio > 3) AS bad, sum(ratio) AS s FROM rat GROUP BY 1, 2) GROUP BY 1", use="rat")(
    lambda s, r: P.validate_profiles(RAT(s, r), 0.2, 3.0))
define("two", "filled rat", "SELECT d.area, d.day, g.p::INTEGER AS period, d.m AS daily_mean, greatest(d.m * coalesce(greatest(least(t.ratio, 5), 0.1), 1), 0) AS load FROM (SELECT area, ts::DATE AS day, avg(load) AS m FROM filled GROUP BY 1, 2) d CROSS JOIN range(48) g(p) LEFT JOIN rat t ON t.area = d.area AND t.day = d.day AND t.period = g.p")
TWO = lambda s, r: P.combine_profiles(P.daily_mean(tb.filled(s, r)), RAT(s, r))
query("k17_combine_profiles", "SELECT * FROM two", use="two", rd="daily_mean load")(TWO)
query("k18_fit_two_stage")(lambda s, r: P.fit_two_stage(tb.filled(s, r)))
query("k18_fit_two_stage_hw")(lambda s, r: P.fit_two_stage(tb.filled(s, r), "hw", "hw"))
query("k19_energy_check", "SELECT area, day, total, expected, abs(total - expected) / expected AS relative_error, abs(total - expected) / expected <= 0.05 AS conserved FROM (SELECT area, day, sum(load) AS total, 48 * max(daily_mean) AS expected FROM two GROUP BY 1, 2)", use="two", rd="total expected relative_error")(
    lambda s, r: P.energy_check(TWO(s, r)))
query("k20_profile_bound_test", "SELECT area, avg((ratio < 0.3 OR ratio > 2.5)::INTEGER) AS violation_rate, min(ratio) AS min_ratio, max(ratio) AS max_ratio FROM rat GROUP BY 1", use="rat", rd="violation_rate min_ratio max_ratio")(
    lambda s, r: P.profile_bound_test(RAT(s, r)))
query("k21_seasonal_consistency", "SELECT area, avg(sd) AS mean_std, max(sd) AS max_std FROM (SELECT area, stddev_samp(ratio) AS sd FROM rat GROUP BY area, isodow(day), period // 2) GROUP BY 1", use="rat", rd="mean_std max_std")(
    lambda s, r: P.seasonal_consistency(RAT(s, r)))
query("k22_decompose_forecast", "SELECT area, ts, load, avg(load) OVER p AS daily_mean, greatest(least(load / (avg(load) OVER p + 1e-8), 10), 0.01) AS ratio FROM filled WINDOW p AS (PARTITION BY area, ts::DATE)", use="filled", rd="load daily_mean ratio")(
    lambda s, r: P.decompose_forecast(tb.filled(s, r)))
query("k23_train_all")(lambda s, r: T.train_pooled(TR(s, r), COLS, "target")[1])
query("k23_train_areas")(lambda s, r: T.train_all(TR(s, r), COLS, "target")[1])
query("k24_tune")(lambda s, r: T.tune_pooled(TR(s, r), COLS, "target", {"depth": [2, 4]}))
query("k25_model_report", "SELECT area, model, count(*) AS n, avg(y - yhat) AS mean_error, stddev_samp(y - yhat) AS std_error, avg(abs(y - yhat)) AS mae, max(abs(y - yhat)) AS max_error, min(ts) AS first, max(ts) AS last FROM scored GROUP BY 1, 2", use="scored", rd="mean_error std_error mae max_error")(
    lambda s, r: T.model_report(SC(s, r)))
query("k26_simple_intervals", "SELECT area, ts, model, horizon, yhat, y, yhat - 1.96 * abs(yhat) * 0.05 * (1 + 0.1 * horizon) AS lo, yhat + 1.96 * abs(yhat) * 0.05 * (1 + 0.1 * horizon) AS hi FROM scored", use="scored", rd="yhat y lo hi")(
    lambda s, r: P.simple_intervals(SC(s, r)))
query("k27_predict_job", f"SELECT ts, horizon, node, yhat, yhat - 1.96 * abs(yhat) * 0.05 * 1.1 AS lo, yhat + 1.96 * abs(yhat) * 0.05 * 1.1 AS hi FROM (SELECT *, 1 AS horizon FROM ({PROP}))", use="nfa", rd="yhat lo hi", digits=4)(
    lambda s, r: T.predict_job(every_fc(s, r)[0].withColumn("horizon", F.lit(1)), E(s, r), "TOTAL", scratch(s, "predict")))
query("k28_train_job")(lambda s, r: T.train_job_pooled(TR(s, r), COLS, "target"))
query("k29_two_stage_checks", """SELECT area, 'energy' AS test, max(abs(total - expected) / expected) AS value, max(abs(total - expected) / expected) <= 0.05 AS passed FROM (SELECT area, day, sum(load) AS total, 48 * max(daily_mean) AS expected FROM two GROUP BY 1, 2) GROUP BY 1
 UNION ALL SELECT area, 'bounds', avg((ratio < 0.3 OR ratio > 2.5)::INTEGER), avg((ratio < 0.3 OR ratio > 2.5)::INTEGER) <= 0.05 FROM rat GROUP BY 1 UNION ALL SELECT area, 'seasonal', avg(sd), avg(sd) <= 0.5 FROM (SELECT area, stddev_samp(ratio) AS sd FROM rat GROUP BY area, isodow(day), period // 2) GROUP BY 1""", use="two rat", rd="value")(
    lambda s, r: P.two_stage_checks(TWO(s, r), RAT(s, r)))

# --- intraday -------------------------------------------------------------------------
# every model and horizon is a series of its own
GRP = "area, model, horizon"
BY = ("area", "model", "horizon")
RERR = """SELECT {g}, ts, observed, predicted, observed - predicted AS error, CASE WHEN predicted = 0 THEN 0 ELSE greatest(least(observed / predicted - 1, 0.5), -0.5) END AS error_ratio,
 (hour(ts) * 2 + minute(ts) // 30)::INTEGER AS period, (isodow(ts) - 1)::INTEGER AS weekday,
 pow(0.95, epoch(max(ts) OVER (PARTITION BY {g}) - ts) / 3600.0::DOUBLE) AS weight, epoch(max(ts) OVER (PARTITION BY {g}) - ts) / 3600.0::DOUBLE AS age_hours FROM {src}"""
CFAC = """SELECT {g}, p::INTEGER AS period, coalesce(o.f, g.f) AS factor, coalesce(o.n, 0) AS n
 FROM (SELECT {g}, sum(error * weight) / sum(weight) AS f FROM {src} WHERE age_hours <= 6 GROUP BY {g} HAVING count(*) >= 3) g CROSS JOIN (SELECT unnest(range(48)) AS period, unnest(range(48)) AS p)
 LEFT JOIN (SELECT {g}, period, sum(error * weight) / sum(weight) AS f, count(*) AS n FROM {src} WHERE age_hours <= 6 GROUP BY {g}, period) o USING ({g}, period)"""
define("obs", "scored", f"SELECT {GRP}, ts, y AS observed, yhat AS predicted FROM scored")
define("rerr", "obs", RERR.format(g=GRP, src="obs"))
define("obs1", "scored", "SELECT area, ts, y AS observed, yhat AS predicted FROM scored WHERE model = 'ma' AND horizon = 1")
define("rerr1", "obs1", RERR.format(g="area", src="obs1"))
define("cfac1", "rerr1", CFAC.format(g="area", src="rerr1"))
OBS = lambda s, r: SC(s, r).select(*BY, "ts", F.col("y").alias("observed"), F.col("yhat").alias("predicted"))
ERR = lambda s, r: I.recent_errors(OBS(s, r), by=BY)
query("b01_recent_errors", "SELECT * FROM rerr", use="rerr", rd="observed predicted error error_ratio weight age_hours")(ERR)
define("cfac", "rerr", CFAC.format(g=GRP, src="rerr"))
FAC = lambda s, r: I.correction_factors(ERR(s, r), by=BY)
query("b02_correction_factors", "SELECT * FROM cfac", use="cfac", rd="factor")(FAC)
BASE = lambda s, r: SC(s, r).select(*BY, "ts", "yhat")
query("b03_apply_correction", f"""SELECT {GRP}, s.ts, s.yhat, hour(s.ts) * 2 + minute(s.ts) // 30 AS period,
 greatest(s.yhat + greatest(least(coalesce(c.factor, 0), abs(s.yhat) * 0.2), -abs(s.yhat) * 0.2), 0) AS corrected
 FROM scored s LEFT JOIN (SELECT {GRP}, period AS cp, factor FROM cfac) c USING ({GRP}) WHERE c.cp IS NULL OR c.cp = hour(s.ts) * 2 + minute(s.ts) // 30""", use="scored cfac", rd="yhat corrected")(
    lambda s, r: I.apply_correction(BASE(s, r), FAC(s, r), by=BY).withColumn("period", F.col("period").cast("bigint")))
query("b04_correction_bounds", f"""SELECT {GRP}, s.ts, s.yhat, greatest(s.yhat - 1.96 * e.sd * [1.0, 1.5, 1.8, 2.0, 2.1, 2.2][horizon + 1], 0) AS lo,
 s.yhat + 1.96 * e.sd * [1.0, 1.5, 1.8, 2.0, 2.1, 2.2][horizon + 1] AS hi FROM scored s JOIN (SELECT {GRP}, coalesce(stddev_samp(error), 0) AS sd FROM rerr GROUP BY {GRP}) e USING ({GRP})""", use="scored rerr", rd="yhat lo hi")(
    lambda s, r: I.correction_bounds(BASE(s, r), ERR(s, r), by=BY))


@query("b05_error_model")
def b05(s, r):
    e = stable(ERR(s, r))
    m = I.error_model(e)
    return s.createDataFrame([(float(m.intercept), float(m.coefficients[0]), float(m.coefficients[1]))], "intercept double, w_period double, w_weekday double")


query("b06_correction_summary", f"SELECT {GRP}, period, count(*) AS n, avg(error) AS mean_error, stddev_samp(error) AS std_error, avg(abs(error)) AS mae, avg(error_ratio) AS mean_ratio FROM rerr GROUP BY {GRP}, period", use="rerr", rd="mean_error std_error mae mean_ratio")(
    lambda s, r: I.correction_summary(ERR(s, r), BY))

# --- streams --------------------------------------------------------------------------
NTZ = lambda d, *cs: d.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cs})
query("x01_stream_load", "SELECT * FROM (SELECT event_type AS area, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, round(sum(value), 2) AS load, count(*) AS n FROM events GROUP BY 1, 2) WHERE ts + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR", rd="load")(
    lambda s, r: NTZ(X.run_available(X.stream_load(X.event_stream(s, r))), "ts"))


@query("x02_stream_dedup", "SELECT event_id, event_type, value FROM events", rd="value")
def x02(s, r):
    twice = X.event_stream(s, r).union(X.event_stream(s, r))
    return X.run_available(X.stream_dedup(twice, ["event_id"]).select("event_id", "event_type", "value"))


query("x03_stream_validate", "SELECT event_id, value, event_type IN ('click','purchase','signup','view') AND value > 0 AS is_valid FROM events", rd="value")(
    lambda s, r: X.run_available(X.stream_validate(X.event_stream(s, r), load_rules(KNOWN, "event_type", "value")).select("event_id", "value", "is_valid")))


@query("x04_stream_correction", "SELECT area, period, factor, n FROM cfac7", use="cfac7", rd="factor")
def x04(s, r):
    src, table = scratch(s, "obs"), scratch(s, "correction")
    OBS(s, r).where("model = 'ma' and horizon = 1").select("area", F.col("ts").cast("timestamp").alias("ts"), "observed", "predicted").write.parquet(src)
    stream = s.readStream.schema("area string, ts timestamp, observed double, predicted double").parquet(src)
    X.stream_correction(NTZ(stream, "ts"), table)
    return X.latest(s, table, "factors")


define("cfac7", "cfac1", "SELECT * FROM cfac1")


@query("x05_stream_align", "SELECT e.event_id, e.event_type AS area, s.ts, s.model, s.horizon, s.yhat FROM events e JOIN scored s ON s.area = e.event_type AND s.ts = time_bucket(INTERVAL 30 MINUTE, e.ts)", use="scored", rd="yhat")
def x05(s, r):
    obs = X.event_stream(s, r).select("event_id", F.col("event_type").alias("area"), F.window("ts", "30 minutes").start.cast("timestamp_ntz").alias("ts"))
    return X.run_available(X.stream_align(obs, stable(SC(s, r))))


@query("x05_stream_align_both", """SELECT a.event_type AS area, a.ts, b.model, b.horizon, b.yhat, a.value AS load FROM events a JOIN (SELECT event_type AS area, ts, 'last' AS model, 0::INTEGER AS horizon, value * 2 AS yhat FROM events) b ON b.area = a.event_type AND b.ts = a.ts""", rd="yhat load")
def x05_both(s, r):
    obs = X.event_stream(s, r).select(F.col("event_type").alias("area"), "ts", F.col("value").alias("load"))
    fc = X.event_stream(s, r).select(F.col("event_type").alias("area"), "ts", F.lit("last").alias("model"), F.lit(0).alias("horizon"), (F.col("value") * 2).alias("yhat"))
    return NTZ(X.run_available(X.stream_align_both(obs, fc)), "ts")


@query("x06_stream_performance", """SELECT model, st AS start, st + INTERVAL 1 DAY AS "end", avg(ae) AS mae, count(*) AS n FROM (SELECT event_type AS model, abs(value - 50) AS ae, time_bucket(INTERVAL 30 MINUTE, ts) - k.k * INTERVAL 30 MINUTE AS st FROM events, range(48) k(k)) WHERE st + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""", rd="mae")
def x06(s, r):
    err = X.event_stream(s, r).select("ts", F.col("event_type").alias("model"), F.abs(F.col("value") - 50).alias("abs_error"))
    return NTZ(X.run_available(X.stream_performance(err)), "start", "end")


@query("x07_stream_drift", """SELECT a.area, page_hinkley, max_cusum FROM (SELECT area, max(u - m) AS page_hinkley FROM (SELECT area, u, min(u) OVER (PARTITION BY area ORDER BY ts, event_id) AS m FROM (SELECT area, ts, event_id, sum(value - mean - 0.005) OVER (PARTITION BY area ORDER BY ts, event_id) AS u FROM (SELECT event_type AS area, ts, event_id, value, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS mean FROM events))) GROUP BY 1) a
 JOIN (SELECT area, max(greatest(cp - least(0, mp), cn - least(0, mn), 0)) AS max_cusum FROM (SELECT *, min(cp) OVER w AS mp, min(cn) OVER w AS mn FROM (SELECT event_type AS area, ts, event_id, sum(value - 50 - 25) OVER w AS cp, sum(50 - value - 25) OVER w AS cn FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)) WINDOW w AS (PARTITION BY area ORDER BY ts, event_id)) GROUP BY 1) b USING (area)""", rd="page_hinkley max_cusum")
def x07(s, r):
    table = scratch(s, "drift")
    X.stream_drift(X.event_stream(s, r).select(F.col("event_type").alias("area"), "ts", F.col("event_id").alias("id"), "value"), table, 50.0, 50.0)
    return X.latest(s, table, "state").select("area", "page_hinkley", "max_cusum")


query("k02_train_areas")(lambda s, r: B.importance(T.train_areas(TR(s, r), COLS, "target")))
query("k02_train_gbt")(lambda s, r: (lambda m: s.createDataFrame([(f, float(v)) for f, v in zip(COLS, m.featureImportances.toArray())], "feature string, importance double"))(
    T.train_gbt(TR(s, r), COLS, "target")))


DRIFT = """SELECT a.area, page_hinkley, max_cusum FROM (
 SELECT area, max(u - m) AS page_hinkley FROM (SELECT area, u, min(u) OVER (PARTITION BY area ORDER BY ts, event_id) AS m FROM (
  SELECT area, ts, event_id, sum(value - mean - 0.005) OVER (PARTITION BY area ORDER BY ts, event_id) AS u FROM (
   SELECT event_type AS area, ts, event_id, value, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS mean FROM {src}))) GROUP BY 1) a
 JOIN (SELECT area, max(greatest(cp - least(0, mp), cn - least(0, mn), 0)) AS max_cusum FROM (SELECT *, min(cp) OVER w AS mp, min(cn) OVER w AS mn FROM (
  SELECT event_type AS area, ts, event_id, sum(value - 50 - 25) OVER w AS cp, sum(50 - value - 25) OVER w AS cn FROM {src} WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
  WINDOW w AS (PARTITION BY area ORDER BY ts, event_id)) GROUP BY 1) b USING (area)"""
PASSED = "(SELECT * FROM events WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)"


@query("x07_stream_drift_keyed", DRIFT.format(src=PASSED), rd="page_hinkley max_cusum")
def x07_keyed(s, r):
    """Hours that the watermark has passed; state variables and timers."""
    hourly = K.run_keyed(K.keyed_drift(X.event_stream(s, r).select(F.col("event_type").alias("area"), "ts", F.col("event_id").alias("id"), "value"), 50.0, 50.0))
    return hourly.groupBy("area").agg(F.max_by(F.struct("page_hinkley", "max_cusum"), "hour").alias("l")).select("area", "l.*")


@query("x04_stream_correction_keyed", "SELECT area, period, factor, n FROM cfac7", use="cfac7", rd="factor")
def x04_keyed(s, r):
    src = scratch(s, "obs")
    OBS(s, r).where("model = 'ma' and horizon = 1").select("area", F.col("ts").cast("timestamp").alias("ts"), "observed", "predicted").write.parquet(src)
    made = K.run_keyed(K.keyed_correction(s.readStream.schema("area string, ts timestamp, observed double, predicted double").parquet(src)))
    newest = made.groupBy("area").agg(F.max("asof").alias("asof"))
    return made.join(newest, ["area", "asof"]).select("area", F.col("period").cast("bigint").alias("period"), "factor", "n")


@query("k04_train_rf")
def k04(s, r):
    models = T.train_rf(TR(s, r).drop("target"), "load", COLS, [1, 7], 1, tb.DAY)
    rows = [(h, f, float(v)) for h, (m, feats) in models.items() for f, v in zip(feats, m.featureImportances.toArray())]
    return s.createDataFrame(rows, "horizon int, feature string, importance double")

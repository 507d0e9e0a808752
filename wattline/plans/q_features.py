"""Window features, decomposition, importance."""

import math

from pyspark.sql import functions as F

from wattline.operators import decompose as X
from wattline.operators import features as W
from wattline.operators import selection as S
from wattline.operators.folds import dealt
from wattline.operators.timeparts import temporal_features
from wattline.plans.base import query
from wattline.plans.ctes import define
from wattline.sources import tables as tb

P = "PARTITION BY area ORDER BY ts"
query("w01_lag_features", f"SELECT area, ts, load, {', '.join(f'lag(load, {k}) OVER w AS load_lag_{k}' for k in (1, 2, 24, 168))} FROM series WINDOW w AS ({P})", use="series", rd="load load_lag_1 load_lag_2 load_lag_24 load_lag_168")(
    lambda s, r: W.lag_features(tb.series(s, r), ["load"]))
query("w01_lag_features_grid", f"SELECT area, ts, load, {', '.join(f'lag(load, {k}) OVER w AS load_lag_{k}' for k in (1, 2, 24, 168))} FROM filled WINDOW w AS ({P})", use="filled", rd="load load_lag_1 load_lag_2 load_lag_24 load_lag_168")(
    lambda s, r: W.lag_features(tb.filled(s, r), ["load"], step=30))


def _roll(n):
    fn = {"mean": "avg(load)", "std": "stddev_samp(load)", "min": "min(load)", "max": "max(load)", "median": "quantile_cont(load, 0.5)", "sum": "sum(load)"}
    fr = f"OVER ({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return [f"CASE WHEN count(load) {fr} = {n} THEN {e} {fr} END AS load_rolling_{n}_{k}" for k, e in fn.items()]


query("w02_rolling_features", f"SELECT area, ts, load, {', '.join(_roll(4) + _roll(48))} FROM grid", use="grid",
      rd="load " + " ".join(f"load_rolling_{n}_{k}" for n in (4, 48) for k in W.STATS))(
    lambda s, r: W.rolling_features(tb.grid(s, r), ["load"], [4, 48], W.STATS, step=30))
query("w03_fill_features", f"SELECT area, ts, load, first_value(lag4 IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS load_lag_4 FROM (SELECT *, lag(load, 4) OVER ({P}) AS lag4 FROM grid)", use="grid", rd="load load_lag_4")(
    lambda s, r: W.fill_features(W.lag_features(tb.grid(s, r), ["load"], [4], step=30), ["load_lag_4"], "backward"))
query("w04_null_stats", f"SELECT 'load_lag_1' AS feature, count(*) AS rows, count(*) FILTER (l IS NULL) AS nulls, count(*) FILTER (l IS NULL) / count(*)::DOUBLE AS null_pct FROM (SELECT lag(load) OVER ({P}) AS l FROM grid)", use="grid", rd="null_pct")(
    lambda s, r: W.null_stats(W.lag_features(tb.grid(s, r), ["load"], [1], step=30), ["load_lag_1"]))
define("blf", "filled", f"""SELECT area, ts, load, coalesce(avg(load) OVER (PARTITION BY area, hour(ts), isodow(ts) ORDER BY rn RANGE BETWEEN 672 PRECEDING AND 1 PRECEDING),
 avg(load) OVER ({P} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), load) AS baseline FROM (SELECT *, row_number() OVER ({P}) AS rn FROM filled)""")
BLF = lambda s, r: W.blf_baseline(tb.filled(s, r), step=30)
query("w05_blf_baseline", "SELECT * FROM blf", use="blf", rd="load baseline")(BLF)
query("w05_blf_baseline_rows", "SELECT * FROM blf", use="blf", rd="load baseline")(lambda s, r: W.blf_baseline(tb.filled(s, r)))
query("w06_baseline_ratio", "SELECT area, ts, load, baseline, greatest(least(CASE WHEN baseline = 0 THEN 1.0 ELSE load / baseline END, 10.0), 0.1) AS baseline_ratio FROM blf", use="blf", rd="load baseline baseline_ratio")(
    lambda s, r: W.baseline_ratio(BLF(s, r)))
query("w07_baseline_correction", f"SELECT area, ts, load, baseline, {', '.join(f'avg(load - baseline) OVER ({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS correction_{n}' for n in (24, 48, 168))} FROM blf", use="blf", rd="load baseline correction_24 correction_48 correction_168")(
    lambda s, r: W.baseline_correction(BLF(s, r), step=30))
query("w08_hourly_profile", "SELECT area, ts, load, avg(load) OVER (PARTITION BY area, hour(ts)) AS hourly_profile, load - avg(load) OVER (PARTITION BY area, hour(ts)) AS profile_deviation FROM series", use="series", rd="load hourly_profile profile_deviation")(
    lambda s, r: W.hourly_profile(tb.series(s, r)))
LOESS = """SELECT area, i, my + CASE WHEN vx > 0 THEN cxy / vx * (i - mx) ELSE 0 END AS s FROM (
 SELECT area, i, sum(w * xj) / sum(w) AS mx, sum(w * yj) / sum(w) AS my, sum(w * (xj - i) * yj) - sum(w * (xj - i)) * sum(w * yj) / sum(w) AS cxy,
  sum(w * (xj - i) * (xj - i)) - sum(w * (xj - i)) * sum(w * (xj - i)) / sum(w) AS vx FROM (
  SELECT a.area, a.i, b.i AS xj, b.load AS yj, b.rob * pow(1 - pow(abs(b.i - a.i) / greatest(a.i - a.lo, a.lo + a.k - 1 - a.i)::DOUBLE, 3), 3) AS w
  FROM (SELECT *, greatest(1, least(i - k // 2, n - k + 1)) AS lo FROM {src}) a JOIN {src} b ON b.area = a.area AND b.i BETWEEN a.lo AND a.lo + a.k - 1) GROUP BY ALL)"""
ROBUST = """SELECT area, ts, load, i, n, k, CASE WHEN mad = 0 THEN 1.0 ELSE pow(1 - pow(least(r / (6 * mad), 1), 2), 2) END::DOUBLE AS rob FROM (
 SELECT p.*, abs(load - s) AS r FROM {src} p JOIN {fit} USING (area, i)) JOIN (SELECT area, quantile_cont(abs(load - s), 0.5) AS mad FROM {src} JOIN {fit} USING (area, i) GROUP BY 1) USING (area)"""
define("pos", "filled", f"SELECT *, greatest(3, ceil(0.1 * n))::BIGINT AS k, 1.0::DOUBLE AS rob FROM (SELECT *, row_number() OVER ({P}) AS i, count(*) OVER (PARTITION BY area) AS n FROM filled)")
define("fit1", "pos", LOESS.format(src="pos"))
define("pos2", "pos fit1", ROBUST.format(src="pos", fit="fit1"))
define("fit2", "pos2", LOESS.format(src="pos2"))
define("pos3", "pos2 fit2", ROBUST.format(src="pos2", fit="fit2"))
define("fit3", "pos3", LOESS.format(src="pos3"))
query("w09_loess", "SELECT area, ts, load, s AS load_smooth, load - s AS load_residual FROM pos JOIN fit3 USING (area, i)", use="pos fit3", rd="load load_smooth load_residual", digits=5)(
    lambda s, r: X.loess(tb.filled(s, r)))
query("w09_loess_single", "SELECT area, ts, load, s AS load_smooth, load - s AS load_residual FROM pos JOIN fit1 USING (area, i)", use="pos fit1", rd="load load_smooth load_residual", digits=5)(
    lambda s, r: X.loess(tb.filled(s, r), iterations=1))
query("w09_loess_robust")(lambda s, r: X.loess(tb.filled(s, r), degree=2))
query("w10_wavelet_haar", f"""SELECT area, ts, load, (x0 + x1) / 2 AS load_approx, CASE WHEN i % 2 = 0 THEN (x0 - x1) / 2 ELSE (x1 - x0) / 2 END AS load_detail_1 FROM (
 SELECT area, ts, load, i, CASE WHEN i % 2 = 0 THEN load ELSE lag(load) OVER w END AS x0, CASE WHEN i % 2 = 1 THEN load ELSE coalesce(lead(load) OVER w, load) END AS x1 FROM (SELECT *, row_number() OVER ({P}) - 1 AS i FROM filled) WINDOW w AS ({P}))""", use="filled", rd="load load_approx load_detail_1")(
    lambda s, r: X.wavelet(tb.filled(s, r), wavelet="haar", level=1))
query("w10_wavelet_db4")(lambda s, r: X.wavelet(tb.filled(s, r), wavelet="db4", level=3))

TREND = f"""(sum({{c}}) OVER f - coalesce(lag({{c}}, {{h}}) OVER w, 0) / 2 - coalesce(lead({{c}}, {{h}}) OVER w, 0) / 2) / (count({{c}}) OVER f - CASE WHEN lag({{c}}, {{h}}) OVER w IS NOT NULL THEN 0.5 ELSE 0 END - CASE WHEN lead({{c}}, {{h}}) OVER w IS NOT NULL THEN 0.5 ELSE 0 END)::DOUBLE AS trend"""


def _dec(src, c, p):
    tr = f"avg({c}) OVER f AS trend" if p % 2 else TREND.format(c=c, h=p // 2)
    return f"""SELECT a.* EXCLUDE (rn), m.s - n.c AS seasonal, a.{c} - a.trend - (m.s - n.c) AS residual FROM (
 SELECT *, {tr}, row_number() OVER w AS rn FROM {src} WINDOW w AS ({P}), f AS ({P} ROWS BETWEEN {p // 2} PRECEDING AND {p // 2} FOLLOWING)) a
 JOIN (SELECT area, (rn - 1) % {p} AS ph, avg({c} - trend) AS s FROM (SELECT *, {tr}, row_number() OVER w AS rn FROM {src} WINDOW w AS ({P}), f AS ({P} ROWS BETWEEN {p // 2} PRECEDING AND {p // 2} FOLLOWING)) GROUP BY 1, 2) m ON m.area = a.area AND m.ph = (a.rn - 1) % {p}
 JOIN (SELECT area, avg(s) AS c FROM (SELECT area, (rn - 1) % {p} AS ph, avg({c} - trend) AS s FROM (SELECT *, {tr}, row_number() OVER w AS rn FROM {src} WINDOW w AS ({P}), f AS ({P} ROWS BETWEEN {p // 2} PRECEDING AND {p // 2} FOLLOWING)) GROUP BY 1, 2) GROUP BY 1) n ON n.area = a.area"""


define("dec", "filled", _dec("filled", "load", 48))
query("w11_decompose", "SELECT * FROM dec", use="dec", rd="load trend seasonal residual")(lambda s, r: X.decompose(tb.filled(s, r), step=30))
query("w11_decompose_robust")(lambda s, r: X.decompose(tb.filled(s, r), robust=True, step=30))
define("dec1", "dec", "SELECT area, ts, load, seasonal AS seasonal_daily, load - seasonal AS x FROM dec")
define("dec2", "dec1", _dec("dec1", "x", 336))
define("multi", "dec2", "SELECT area, ts, load, seasonal_daily, seasonal AS seasonal_weekly, trend, x - seasonal - trend AS residual FROM dec2")
MULTI = lambda s, r: X.decompose_multi(tb.filled(s, r), step=30, harmonics={})
query("w12_decompose_multi", "SELECT * FROM multi", use="multi", rd="load seasonal_daily seasonal_weekly trend residual")(MULTI)


def _yearly_sql(k: int) -> str:
    """Regression on waves and a trend, one column at a time: each later column gives up what it shares with an earlier one."""
    cols = [f"{f}{j}" for j in range(1, k + 1) for f in ("co", "si")]
    at = "(epoch(ts) / 86400.0)::DOUBLE"
    start = ", ".join(f"{'cos' if c[:2] == 'co' else 'sin'}({2 * math.pi} * {c[2:]} / 365.25 * {at}) AS {c}" for c in cols)
    names = [*cols, "tr", "r"]
    mean = lambda c: f"{c} - avg({c}) OVER (PARTITION BY area) AS {c}"
    sql = f"SELECT area, ts, load, tr AS x, {', '.join(mean(c) for c in names)} FROM (SELECT area, ts, load, load AS r, ({at} - 10000) / 365.25 AS tr, {start} FROM dfilled)"
    for i, q in enumerate(names[:-1]):
        less = ", ".join(f"{c} - {q} * sum({c} * {q}) OVER (PARTITION BY area) / sum({q} * {q}) OVER (PARTITION BY area) AS {c}" for c in names[i + 1:])
        slope = f", sum(r * {q}) OVER (PARTITION BY area) / sum({q} * {q}) OVER (PARTITION BY area) AS slope" if q == "tr" else ""
        sql = f"SELECT area, ts, load, x, {less}{slope} FROM ({sql})"
    return f"SELECT area, ts, load, load - avg(load) OVER (PARTITION BY area) - r - slope * (x - avg(x) OVER (PARTITION BY area)) AS seasonal_yearly FROM ({sql})"


define("yearly", "dfilled", _yearly_sql(3))
define("yx", "yearly", "SELECT area, ts, load, seasonal_yearly, load - seasonal_yearly AS x FROM yearly")
define("ydec", "yx", _dec("yx", "x", 7))
YEAR = lambda s, r: X.decompose_multi(tb.daily_filled(s, r), periods={"weekly": 7}, step=tb.DAY)
query("w12_decompose_yearly", "SELECT area, ts, load, seasonal_yearly, seasonal AS seasonal_weekly, trend, residual FROM ydec", use="ydec", rd="load seasonal_yearly seasonal_weekly trend residual", digits=4)(YEAR)
query("w13_yearly_features", f"""SELECT area, ts, load, seasonal_yearly, seasonal_weekly, trend, residual, lag(seasonal_weekly) OVER w AS seasonal_weekly_lag_1, seasonal_weekly - lag(seasonal_weekly, 7) OVER w AS seasonal_weekly_diff,
 lag(seasonal_yearly) OVER w AS seasonal_yearly_lag_1, seasonal_yearly - lag(seasonal_yearly, 365) OVER w AS seasonal_yearly_diff, seasonal_weekly + seasonal_yearly + residual AS detrended, trend + residual AS deseasonalized
 FROM (SELECT *, seasonal AS seasonal_weekly FROM ydec) WINDOW w AS ({P})""", use="ydec", digits=4,
      rd="load seasonal_yearly seasonal_weekly trend residual seasonal_weekly_lag_1 seasonal_weekly_diff seasonal_yearly_lag_1 seasonal_yearly_diff detrended deseasonalized")(
    lambda s, r: X.component_features(YEAR(s, r), {"weekly": 7, "yearly": 365}, step=tb.DAY))
query("w13_component_features", f"""SELECT *, lag(seasonal_daily) OVER w AS seasonal_daily_lag_1, seasonal_daily - lag(seasonal_daily, 48) OVER w AS seasonal_daily_diff, lag(seasonal_weekly) OVER w AS seasonal_weekly_lag_1, seasonal_weekly - lag(seasonal_weekly, 336) OVER w AS seasonal_weekly_diff,
 seasonal_daily + seasonal_weekly + residual AS detrended, trend + residual AS deseasonalized FROM multi WINDOW w AS ({P})""", use="multi",
      rd="load seasonal_daily seasonal_weekly trend residual seasonal_daily_lag_1 seasonal_daily_diff seasonal_weekly_lag_1 seasonal_weekly_diff detrended deseasonalized")(
    lambda s, r: X.component_features(MULTI(s, r), {"daily": 48, "weekly": 336}, step=30))
query("w14_seasonal_profile", f"SELECT area, (rn - 1) % 48 AS phase, avg(seasonal) AS profile FROM (SELECT *, row_number() OVER ({P}) AS rn, count(*) OVER (PARTITION BY area) AS n FROM dec) WHERE rn <= n // 48 * 48 GROUP BY 1, 2", use="dec", rd="profile")(
    lambda s, r: X.seasonal_profile(X.decompose(tb.filled(s, r), step=30), "seasonal", 48))
query("w15_strength", """SELECT *, CASE WHEN strength > 0.6 THEN 'strong' WHEN strength > 0.3 THEN 'moderate' ELSE 'weak' END AS class FROM (
 SELECT area, 'trend' AS component, greatest(0, 1 - var_samp(residual) / var_samp(trend + residual)) AS strength FROM dec GROUP BY 1
 UNION ALL SELECT area, 'seasonal', greatest(0, 1 - var_samp(residual) / var_samp(seasonal + residual)) FROM dec GROUP BY 1)""", use="dec", rd="strength")(
    lambda s, r: X.strength(X.decompose(tb.filled(s, r), step=30), ["trend", "seasonal"]))
query("w16_load_context", f"""SELECT area, ts, load, coalesce(stddev_samp(load) OVER ({P} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW), 0) AS load_volatility, coalesce(load - lag(load) OVER ({P}), 0) AS load_trend,
 CASE WHEN m > 0 THEN load / m ELSE 0 END AS load_level, (load < q1)::INTEGER AS load_regime_low, (load > q3)::INTEGER AS load_regime_high
 FROM filled JOIN (SELECT area, avg(load) AS m, quantile_cont(load, 0.25) AS q1, quantile_cont(load, 0.75) AS q3 FROM filled GROUP BY 1) USING (area)""", use="filled", rd="load load_volatility load_trend load_level")(
    lambda s, r: W.load_context(tb.filled(s, r), step=30))
query("w17_weather_context", """SELECT grp, ts, temperature, temperature - m AS temp_deviation, (temperature > hi)::INTEGER AS temp_extreme_high, (temperature < lo)::INTEGER AS temp_extreme_low
 FROM (SELECT 'all' AS grp, * FROM exog), (SELECT avg(temperature) AS m, quantile_cont(temperature, 0.05) AS lo, quantile_cont(temperature, 0.95) AS hi FROM exog)""", use="exog", rd="temperature temp_deviation")(
    lambda s, r: W.weather_context(tb.exogenous(s, r).withColumn("grp", F.lit("all")), by=["grp"]).select("grp", "ts", "temperature", "temp_deviation", "temp_extreme_high", "temp_extreme_low"))
query("w18_time_context", "SELECT area, ts, hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS day_of_week, month(ts)::INTEGER AS month, quarter(ts)::INTEGER AS quarter, (isodow(ts) > 5)::INTEGER AS is_weekend, sin(2*pi()*hour(ts)/24) AS hour_sin, cos(2*pi()*hour(ts)/24) AS hour_cos, sin(2*pi()*(isodow(ts)-1)/7) AS day_of_week_sin, cos(2*pi()*(isodow(ts)-1)/7) AS day_of_week_cos, sin(2*pi()*(month(ts)-1)/12) AS month_sin, cos(2*pi()*(month(ts)-1)/12) AS month_cos FROM series",
      use="series", rd="hour_sin hour_cos day_of_week_sin day_of_week_cos month_sin month_cos")(
    lambda s, r: W.time_context(tb.series(s, r).drop("load")))


@query("w19_feature_steps", f"SELECT area, ts, load, hour(ts)::INTEGER AS hour, lag(load, 48) OVER ({P}) AS load_lag_48, load / 2 AS half_load FROM filled", use="filled", rd="load load_lag_48 half_load")
def w19(s, r):
    steps = [
        W.FeatureStep("time", ["hour"], temporal_features, {"t": "ts", "features": ["hour"]}),
        W.FeatureStep("lag", ["load_lag_48"], W.lag_features, {"cols": ["load"], "periods": [48], "step": 30}),
        W.FeatureStep("half", ["half_load"], lambda d: d.withColumn("half_load", F.col("load") / 2)),
    ]
    return W.feature_pipeline(tb.filled(s, r), steps)


def log(s, r):
    """An importance log: one score per shipped line."""
    return tb.load(s, r, "lineitem").select(
        F.concat("l_returnflag", F.lit("_"), "l_linestatus").alias("feature"), F.col("l_discount").alias("score"),
        F.col("l_linestatus").alias("type"), F.col("l_suppkey").cast("string").alias("model_id"), F.col("l_shipdate").alias("timestamp"))


define("implog", "", "SELECT l_returnflag || '_' || l_linestatus AS feature, l_discount AS score, l_linestatus AS type, l_suppkey::VARCHAR AS model_id, l_shipdate AS timestamp FROM lineitem")


@query("f02_leakage_safe_select", "SELECT area, ts, load_lag_96 FROM (SELECT area, ts, lag(load, 96) OVER (PARTITION BY area ORDER BY ts) AS load_lag_96 FROM filled)", use="filled", rd="load_lag_96")
def f01(s, r):
    d = W.lag_features(tb.filled(s, r), ["load"], [24, 48, 96], step=30).withColumn("future_load", F.col("load"))
    keep = S.safe_features([c for c in d.columns if c not in ("area", "ts")], 2, 48, "load")
    return d.select("area", "ts", *keep)


LEAKS = {
    "load_lag_24": ("lag(load, 24) OVER w", "lag"), "load_lag_48": ("lag(load, 48) OVER w", "lag"), "load_lag_96": ("lag(load, 96) OVER w", None),
    "hour": ("hour(ts)::DOUBLE", None), "future_load": ("load + hour(ts)", "name"), "load_doubled": ("2 * load", None),
}
define("leaks", "filled", f"SELECT load, {', '.join(f'{e} AS {c}' for c, (e, _) in LEAKS.items())} FROM filled WINDOW w AS (PARTITION BY area ORDER BY ts)")


def _leak_sql(c: str, reason: str | None) -> str:
    why = f"'{reason}'" if reason else "NULL::VARCHAR"
    return f"""SELECT '{c}' AS feature, 2::INTEGER AS horizon, {why} AS reason, {why} IS NULL AS is_safe, count({c}) AS n, corr({c}, load) AS correlation,
 CASE WHEN {why} IS NOT NULL THEN 'not known at horizon 2' WHEN abs(corr({c}, load)) >= 0.999 THEN 'nearly equals the target' END AS warning FROM leaks"""


@query("f02_leakage_report", " UNION ALL ".join(_leak_sql(c, why) for c, (_, why) in LEAKS.items()), use="leaks", rd="correlation")
def f02(s, r):
    d = W.lag_features(tb.filled(s, r), ["load"], [24, 48, 96], step=30)
    d = d.withColumns({"hour": F.hour("ts"), "future_load": F.col("load") + F.hour("ts"), "load_doubled": 2 * F.col("load")})
    return S.leakage_check(d, list(LEAKS), "load", 2)


for _h, _e in {"mean": "avg(score)", "median": "median(score)", "max": "max(score)"}.items():
    query(f"f08_importance_{_h}", f"SELECT feature, {_e} AS importance FROM implog GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4", use="implog", rd="importance")(
        lambda s, r, h=_h: S.importance_agg(log(s, r), h, 4))
query("f09_importance_trend", "SELECT timestamp, model_id, score FROM implog WHERE feature = 'A_F'", use="implog", rd="score")(
    lambda s, r: S.importance_trend(log(s, r), "A_F"))
query("f10_importance_stability", "SELECT feature, avg(score) AS mean, stddev_samp(score) AS std, count(score) AS count, min(score) AS min, max(score) AS max, stddev_samp(score) / avg(score) AS cv FROM implog GROUP BY 1", use="implog", rd="mean std min max cv")(
    lambda s, r: S.importance_stability(log(s, r)))


def training_rows(s, r):
    """Daily order value with lags, calendar parts and the next-day target."""
    from wattline.operators.joins import horizon_target

    d = W.lag_features(tb.daily_filled_once(s, r), ["load"], [1, 2, 7, 14], step=tb.DAY)
    d = temporal_features(d, "ts", ["day_of_week", "day_of_month", "month"])
    return dealt(horizon_target(d, 1, 1, step=tb.DAY).withColumnRenamed("target_h1", "target"))


COLS = ["load", "load_lag_1", "load_lag_2", "load_lag_7", "load_lag_14", "day_of_week", "day_of_month", "month"]
query("f03_select_by_importance")(lambda s, r: S.select_by_importance(training_rows(s, r).drop("area"), "target", COLS, 1, min_features=5, ppd=1))
query("f04_select_rfe")(lambda s, r: S.select_rfe(training_rows(s, r), "target", COLS, min_features=4))


def _perm(s, r):
    d = training_rows(s, r).persist()
    model, _ = S.forest_importance(d, COLS, "target")
    return S.permutation_importance(model, d, COLS, "target", ["area", "ts"])


query("f05_permutation_importance")(_perm)
query("f06_select_combined")(lambda s, r: S.select_combined(
    S.select_by_importance(training_rows(s, r), "target", COLS, 1, min_features=3, max_features=3, threshold=0.05, ppd=1),
    S.select_by_importance(training_rows(s, r), "target", COLS[2:], 1, min_features=3, max_features=3, threshold=0.05, ppd=1)))
query("f07_selection_report")(lambda s, r: S.selection_report(S.select_by_importance(training_rows(s, r), "target", COLS, 1, min_features=5, ppd=1)))


@query("f01_safe_features", "SELECT area, ts, lag(load, 48) OVER w AS load_lag_48, lag(load, 96) OVER w AS load_lag_96 FROM filled WINDOW w AS (PARTITION BY area ORDER BY ts)", use="filled", rd="load_lag_48 load_lag_96")
def f01_day_ahead(s, r):
    d = W.lag_features(tb.filled(s, r), ["load"], [24, 48, 96], step=30).withColumn("actual_load", F.col("load"))
    return d.select("area", "ts", *S.safe_features([c for c in d.columns if c not in ("area", "ts")], 1, 48, "load"))


@query("w20_user_step", "SELECT area, ts, load, load - avg(load) OVER (PARTITION BY area, ts::DATE) AS above_day FROM filled", use="filled", rd="load above_day")
def w20(s, r):
    """A step written by the user: any DataFrame -> DataFrame function."""

    def above_day(d):
        m = d.groupBy("area", F.to_date("ts").alias("d")).agg(F.avg("load").alias("m"))
        return d.withColumn("d", F.to_date("ts")).join(m, ["area", "d"]).withColumn("above_day", F.col("load") - F.col("m")).drop("d", "m")

    return W.feature_pipeline(tb.filled(s, r), [W.FeatureStep("above_day", ["above_day"], above_day)])

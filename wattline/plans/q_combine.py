"""Combination, bias, diversity, weight checks."""

from pyspark.sql import functions as F

from wattline.functions.ordered import stable
from wattline.operators import bias as B
from wattline.operators import combine as C
from wattline.operators import diversity as V
from wattline.operators import ensemble as N
from wattline.operators.features import time_context
from wattline.plans.base import query
from wattline.plans.ctes import CTES, define
from wattline.plans.q_metrics import SC, p_normal, p_t, with_p
from wattline.sources import tables as tb
from wattline.sources.tables import MODELS

K = ["ts", "area", "horizon"]
query("m01_combine_mean", "SELECT ts, area, horizon, avg(yhat) AS yhat, count(yhat) AS n_models FROM fcrows GROUP BY 1, 2, 3", use="fcrows", rd="yhat")(
    lambda s, r: C.combine_mean(tb.forecasts(s, r)))
define("mw", "scored", "SELECT model, weight / sum(weight) OVER () AS weight FROM (SELECT model, 1 / greatest(avg(abs(y - yhat)), 1e-10) AS weight FROM scored GROUP BY 1)")
MW = lambda s, r: C.weights_inverse_error(SC(s, r))
query("m02_combine_weighted", "SELECT ts, area, horizon, sum(CASE WHEN yhat IS NOT NULL THEN weight * yhat END) / sum(CASE WHEN yhat IS NOT NULL THEN weight END) AS yhat FROM fcrows JOIN mw USING (model) GROUP BY 1, 2, 3", use="fcrows mw", rd="yhat")(
    lambda s, r: C.combine_weighted(tb.forecasts(s, r), MW(s, r)))
query("m03_normalize_weights", "SELECT area, model, w / sum(w) OVER (PARTITION BY area) AS weight FROM (SELECT area, model, avg(abs(y - yhat)) AS w FROM scored GROUP BY 1, 2)", use="scored", rd="weight")(
    lambda s, r: C.normalize_weights(SC(s, r).groupBy("area", "model").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("weight")), ["area"]))
query("m03_check_weights", "SELECT 1.0::DOUBLE AS total, min(weight) AS smallest, true AS ok FROM mw", use="mw", rd="smallest")(lambda s, r: C.check_weights(MW(s, r)))
query("m04_combine_intervals", "SELECT ts, area, horizon, sum(weight * 0.9 * yhat) / sum(weight) AS lo, sum(weight * 1.1 * yhat) / sum(weight) AS hi FROM scored JOIN mw USING (model) GROUP BY 1, 2, 3", use="scored mw", rd="lo hi")(
    lambda s, r: C.combine_intervals(SC(s, r).withColumns({"lo": F.col("yhat") * 0.9, "hi": F.col("yhat") * 1.1}), MW(s, r)))
query("m05_contributions", "SELECT ts, area, horizon, sum(weight * yhat) AS combined, arg_max(model, weight) AS dominant_model, -sum(weight * ln(weight + 1e-10)) AS weight_entropy FROM scored JOIN mw USING (model) GROUP BY 1, 2, 3", use="scored mw", rd="combined weight_entropy")(
    lambda s, r: C.contributions(SC(s, r), MW(s, r)))
query("m06_weights_inverse_error", "SELECT area, model, w / sum(w) OVER (PARTITION BY area) AS weight FROM (SELECT area, model, w / sum(w) OVER (PARTITION BY area) AS w FROM (SELECT area, model, 1 / avg(abs(y - yhat)) AS w FROM scored GROUP BY 1, 2)) WHERE w >= 0.24", use="scored", rd="weight")(
    lambda s, r: C.weights_inverse_error(SC(s, r), ["area"], 0.24))
query("m07_weights_min_mse")(lambda s, r: C.weights_min_mse(SC(s, r), MODELS))
query("m08_weights_min_mae")(lambda s, r: C.weights_min_mae(SC(s, r), MODELS))
query("m08_min_mae_certificate")(lambda s, r: C.min_mae_rounds(SC(s, r), MODELS)[1].select("mae", "bound", (F.col("mae") - F.col("bound") <= 1e-6 * F.col("mae")).alias("proven")))


@query("m09_stack_fold_scores")
def m09(s, r):
    _, sc = C.stack_fit(stable(SC(s, r)), MODELS, [1, 2, 3], "ridge", 2)
    return s.createDataFrame(sc, "horizon int, fold int, rmse double")


@query("m10_stack_apply")
def m10(s, r):
    d = stable(SC(s, r))
    fitted, _ = C.stack_fit(d, MODELS, [1, 2, 3], "linear")
    return C.stack_apply(fitted, d, MODELS)


@query("m10_stack_weights")
def m10b(s, r):
    fitted, _ = C.stack_fit(stable(SC(s, r)), MODELS, [1, 2, 3], "lasso")
    return C.stack_weights(s, fitted, MODELS)


SELM = "100 * avg(abs((y - yhat) / (abs(y) + 1e-8))) AS mape, avg(abs(y - yhat)) AS mae, sqrt(avg((y-yhat)*(y-yhat))) AS rmse, 1 - sum((y-yhat)*(y-yhat)) / (var_pop(y) * count(y) + 1e-8) AS r2"
define("sel", "scored", f"SELECT *, 0.4 * mape + 0.3 * mae + 0.3 * rmse AS combined FROM (SELECT model, {SELM} FROM scored GROUP BY 1)")
define("selh", "scored", f"SELECT *, 0.4 * mape + 0.3 * mae + 0.3 * rmse AS combined FROM (SELECT horizon, model, {SELM} FROM scored GROUP BY 1, 2)")
SRD = "mape mae rmse r2 combined"
query("m11_best_model", "SELECT *, row_number() OVER (ORDER BY mape, model) AS rank FROM sel", use="sel", rd=SRD)(lambda s, r: C.best_model(SC(s, r)))
query("m11_best_model_r2", "SELECT *, row_number() OVER (ORDER BY r2 DESC, model) AS rank FROM sel", use="sel", rd=SRD)(lambda s, r: C.best_model(SC(s, r), "max_r2"))
query("m12_best_per_horizon", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY combined, model) AS rank FROM selh) WHERE rank = 1", use="selh", rd=SRD)(
    lambda s, r: C.best_per_horizon(SC(s, r), "min_combined"))
define("rk", "sel", "SELECT model, row_number() OVER (ORDER BY rmse, model) AS rank FROM sel")
RANK = lambda s, r: C.best_model(SC(s, r), "min_rmse")
query("m13_combine_best", "SELECT ts, area, horizon, coalesce(max(yhat) FILTER (rank = 1), arg_min(yhat, rank)) AS yhat FROM fcrows JOIN rk USING (model) GROUP BY 1, 2, 3", use="fcrows rk", rd="yhat")(
    lambda s, r: C.combine_best(tb.forecasts(s, r), RANK(s, r)))
query("m13_combine_best_average", "SELECT ts, area, horizon, coalesce(max(yhat) FILTER (rank = 1), avg(yhat)) AS yhat FROM fcrows JOIN rk USING (model) GROUP BY 1, 2, 3", use="fcrows rk", rd="yhat")(
    lambda s, r: C.combine_best(tb.forecasts(s, r), RANK(s, r), "simple_average"))

# --- bias --------------------------------------------------------------------------
define("boff", "scored", "SELECT model, greatest(least(avg(y - yhat), avg(abs(y - yhat)) * 0.2), -avg(abs(y - yhat)) * 0.2) AS bias_off FROM scored GROUP BY 1")
define("bfac", "scored", """SELECT model, greatest(least(avg(x), 1.2), 0.8) AS factor FROM (SELECT model, y / (yhat + 1e-8) AS x, quantile_cont(y / (yhat + 1e-8), 0.25) OVER (PARTITION BY model) AS q1, quantile_cont(y / (yhat + 1e-8), 0.75) OVER (PARTITION BY model) AS q3 FROM scored) WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1""")
query("m14_bias_additive", 'SELECT model, bias_off AS "offset" FROM boff', use="boff", rd='"offset"')(lambda s, r: B.bias_additive(SC(s, r)))
query("m15_bias_multiplicative", "SELECT * FROM bfac", use="bfac", rd="factor")(lambda s, r: B.bias_multiplicative(SC(s, r)))
PART_SQL = {"monthly": ("month(ts)", 6, 0.10), "weekday": ("isodow(ts) - 1", 5, None), "half_hour": ("hour(ts) * 2 + minute(ts) // 30", 24, 0.05)}


def _time_table(kind: str, src: str, alpha: float = 0.05) -> str:
    """Calendar table of mean errors: months and half-hours kept by their spread, weekdays by a weekend t-test."""
    part, need, spread = PART_SQL[kind]
    groups = f"SELECT model, ({part})::INTEGER AS part, avg(y - yhat) AS bias, count(*) AS n FROM {src} GROUP BY 1, 2 HAVING count(*) >= 20"
    if spread is None:
        t = f"""SELECT model, na AS n_a, nb AS n_b, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0::DOUBLE / na + 1.0::DOUBLE / nb)) AS statistic FROM (
 SELECT model, count(*) FILTER (w) AS na, count(*) FILTER (NOT w) AS nb, avg(e) FILTER (w) AS ma, avg(e) FILTER (NOT w) AS mb, var_samp(e) FILTER (w) AS va, var_samp(e) FILTER (NOT w) AS vb
 FROM (SELECT model, isodow(ts) > 5 AS w, y - yhat AS e FROM {src}) GROUP BY 1)"""
        keep = f"SELECT model FROM ({with_p(t, p_t('statistic', '(n_a + n_b - 2)'))}) JOIN (SELECT model, count(*) AS c FROM ({groups}) GROUP BY 1) USING (model) WHERE c >= {need} AND p_value < {alpha}"
    else:
        keep = f"""SELECT model FROM (SELECT model, count(*) AS c, stddev_pop(bias) AS sd FROM ({groups}) GROUP BY 1)
 JOIN (SELECT model, abs(avg(y - yhat)) AS m FROM {src} GROUP BY 1) USING (model) WHERE c >= {need} AND sd > {spread} * m"""
    return f"SELECT g.model, '{kind}' AS kind, part, bias, n FROM ({groups}) g JOIN ({keep}) k USING (model)"


for _k in ("monthly", "half_hour"):
    _src, _fn = ("dscored", tb.daily_scored) if _k == "monthly" else ("scored", SC)
    query(f"m16_bias_{_k}", _time_table(_k, _src), use=_src, rd="bias")(lambda s, r, k=_k, f=_fn: B.bias_by_time(f(s, r), k))
query("m16_bias_weekday", _time_table("weekday", "dscored", 0.9), use="dscored", rd="bias")(lambda s, r: B.bias_by_time(tb.daily_scored(s, r), "weekday", alpha=0.9))
for _k in PART_SQL:
    define(f"cal_{_k}", "dscored", _time_table(_k, "dscored", 0.9))
define("dboff", "dscored", CTES["boff"][1].replace("FROM scored", "FROM dscored"))
define("dbfac", "dscored", CTES["bfac"][1].replace("FROM scored", "FROM dscored"))
CAL_JOIN = " ".join(f"LEFT JOIN (SELECT model, part, bias AS b_{k} FROM cal_{k}) {k} ON {k}.model = d.model AND {k}.part = {p.replace('(ts)', '(d.ts)')}" for k, (p, _, _) in PART_SQL.items())
CAL_SUM = " + ".join(f"coalesce(b_{k}, 0)" for k in PART_SQL)
CAL_USE = " ".join(f"cal_{k}" for k in PART_SQL)
CALENDAR = lambda d: [B.bias_by_time(d, k, alpha=0.9) for k in B.PARTS]


@query("m17_apply_bias_calendar", f"""SELECT d.ts, d.area, d.model, d.horizon, greatest((d.yhat + bias_off) * factor + {CAL_SUM}, 0) AS yhat, d.y
 FROM dscored d JOIN dboff o ON o.model = d.model JOIN dbfac f ON f.model = d.model {CAL_JOIN}""", use=f"dscored dboff dbfac {CAL_USE}", rd="yhat y", digits=4)
def m17_calendar(s, r):
    d = stable(tb.daily_scored(s, r))
    return B.apply_bias(d, B.bias_additive(d), B.bias_multiplicative(d), CALENDAR(d))


query("m17_apply_bias", "SELECT ts, area, model, horizon, greatest((yhat + bias_off) * factor, 0) AS yhat, y FROM scored JOIN boff USING (model) JOIN bfac USING (model)", use="scored boff bfac", rd="yhat y")(
    lambda s, r: B.apply_bias(SC(s, r), B.bias_additive(SC(s, r)), B.bias_multiplicative(SC(s, r))))
query("m18_bias_report", "SELECT model, avg(y - yhat) AS bias_before, avg(y - yhat - bias_off) AS bias_after, avg(abs(y - yhat)) AS mae_before, avg(abs(y - greatest(yhat + bias_off, 0))) AS mae_after, 100 * (avg(abs(y - yhat)) - avg(abs(y - greatest(yhat + bias_off, 0)))) / avg(abs(y - yhat)) AS mae_improvement_pct FROM scored JOIN boff USING (model) GROUP BY 1".replace("avg(y - yhat - bias_off)", "avg(y - greatest(yhat + bias_off, 0))"), use="scored boff", rd="bias_before bias_after mae_before mae_after mae_improvement_pct")(
    lambda s, r: B.bias_report(SC(s, r), B.apply_bias(SC(s, r), B.bias_additive(SC(s, r))), ["ts", "area", "model", "horizon"]))
query("m19_bias_spline")(lambda s, r: B.corrected(SC(s, r), *B.bias_spline(stable(SC(s, r)))))


@query("m20_bias_tree")
def m20(s, r):
    d = stable(SC(s, r).withColumns({"hour": F.hour("ts"), "dow": F.weekday("ts")}))
    return B.corrected(d, *B.bias_tree(d, ["hour", "dow"]))


TREND_T = """SELECT model, origin, slope, intercept, r2, n, sqrt(r2 * (n - 2) / (1 - r2)) AS t FROM (
 SELECT model, min(origin) AS origin, regr_slope(e, x) AS slope, regr_intercept(e, x) AS intercept, regr_r2(e, x) AS r2, count(*) AS n FROM (
 SELECT model, min(ts) OVER (PARTITION BY model) AS origin, y - yhat AS e, epoch(ts - min(ts) OVER (PARTITION BY model)) / 86400.0::DOUBLE AS x FROM {src}) GROUP BY 1)"""
for _pre in ("", "d"):
    define(f"{_pre}trend", f"{_pre}scored", f"SELECT *, p_value < 0.05 AS kept FROM ({with_p(TREND_T.format(src=f'{_pre}scored'), p_t('t', '(n - 2)'))})")
query("m21_bias_trend", "SELECT * FROM trend", use="trend", rd="slope intercept r2 t p_value")(lambda s, r: B.bias_trend(SC(s, r)))
query("m22_temporal_share", """SELECT model, (mo + wd) / v AS temporal_share FROM (SELECT model, var_pop(y - yhat) AS v FROM scored GROUP BY 1) JOIN (SELECT model, sum(k * pow(a - m, 2)) / max(n) AS mo FROM (SELECT model, month(ts), avg(y - yhat) AS a, count(*) AS k FROM scored GROUP BY 1, 2) JOIN (SELECT model, avg(y - yhat) AS m, count(*) AS n FROM scored GROUP BY 1) USING (model) GROUP BY 1) USING (model)
 JOIN (SELECT model, sum(k * pow(a - m, 2)) / max(n) AS wd FROM (SELECT model, isodow(ts), avg(y - yhat) AS a, count(*) AS k FROM scored GROUP BY 1, 2) JOIN (SELECT model, avg(y - yhat) AS m, count(*) AS n FROM scored GROUP BY 1) USING (model) GROUP BY 1) USING (model)""", use="scored", rd="temporal_share")(
    lambda s, r: B.temporal_share(SC(s, r)))
query("m22_bias_select")(lambda s, r: B.bias_select(stable(SC(s, r))))


@query("m23_bias_advanced")
def m23(s, r):
    """Every part: trend, spline, tree on hour and weekday, the three calendar tables."""
    d = stable(SC(s, r).withColumns({"hour": F.hour("ts"), "dow": F.weekday("ts")}))
    return B.bias_advanced(d, B.bias_trend(d), B.bias_spline(d), B.bias_tree(d, ["hour", "dow"]), CALENDAR(d)).drop("hour", "dow")


@query("m23_bias_trend_calendar", f"""SELECT ts, area, model, horizon, y, yhat + greatest(least(v - yhat, 0.3 * abs(yhat)), -0.3 * abs(yhat)) AS yhat FROM (
 SELECT d.*, greatest(d.yhat + CASE WHEN kept THEN intercept + slope * (epoch(d.ts - origin) / 86400.0::DOUBLE) ELSE 0 END + {CAL_SUM}, 0) AS v
 FROM dscored d JOIN dtrend t ON t.model = d.model {CAL_JOIN})""", use=f"dscored dtrend {CAL_USE}", rd="yhat y", digits=4)
def m23_calendar(s, r):
    d = stable(tb.daily_scored(s, r))
    return B.bias_advanced(d, B.bias_trend(d), times=CALENDAR(d))


# --- states ------------------------------------------------------------------------
ST = "CASE WHEN round({c}, 9) < 2 THEN 'excellent' WHEN round({c}, 9) < 4 THEN 'good' WHEN round({c}, 9) < 8 THEN 'fair' ELSE 'poor' END"
define("pst", "scored", f"SELECT ts, area, model, mape, {ST.format(c='mape')} AS state FROM (SELECT ts, area, model, avg(100 * abs((y - yhat) / y)) FILTER (y <> 0) AS mape FROM scored GROUP BY 1, 2, 3) WHERE mape IS NOT NULL")
PST = lambda s, r: C.perf_states(SC(s, r))
query("m24_perf_states", "SELECT * FROM pst", use="pst", rd="mape")(PST)
define("trs", "pst", "SELECT model, from_state, to_state, n, n / sum(n) OVER (PARTITION BY model, from_state)::DOUBLE AS probability FROM (SELECT model, from_state, state AS to_state, count(*) AS n FROM (SELECT *, lag(state) OVER (PARTITION BY area, model ORDER BY ts) AS from_state FROM pst) WHERE from_state IS NOT NULL GROUP BY 1, 2, 3)")
query("m25_transitions", "SELECT * FROM trs", use="trs", rd="probability")(lambda s, r: C.transitions(PST(s, r)))
query("m26_next_state", "SELECT area, model, from_state, to_state, probability FROM (SELECT area, model, arg_max(state, ts) AS from_state FROM pst GROUP BY 1, 2) JOIN trs USING (model, from_state)", use="pst trs", rd="probability")(
    lambda s, r: C.next_state(PST(s, r), C.transitions(PST(s, r))))
define("mkw", "pst", """SELECT ts, area, model, raw / sum(raw) OVER (PARTITION BY ts, area) AS weight FROM (SELECT ts, area, model, CASE WHEN m IS NULL THEN 1.0 ELSE CASE WHEN round(m, 9) < 2 THEN 4.0 WHEN round(m, 9) < 4 THEN 2.0 WHEN round(m, 9) < 8 THEN 1.0 ELSE 0.5 END / (m + 1) END::DOUBLE AS raw FROM (
 SELECT *, avg(mape) OVER (PARTITION BY area, model ORDER BY ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS m FROM pst))""")
MKW = lambda s, r: C.markov_weights(PST(s, r))
query("m27_markov_weights", "SELECT * FROM mkw", use="mkw", rd="weight")(MKW)
query("m27_markov_combined", "SELECT ts, area, horizon, sum(weight * yhat) / sum(weight) AS yhat FROM scored JOIN mkw USING (ts, area, model) GROUP BY 1, 2, 3", use="scored mkw", rd="yhat")(
    lambda s, r: C.combine_weighted(SC(s, r), MKW(s, r)))
query("m28_smooth_weights", """SELECT ts, area, model, s / sum(s) OVER (PARTITION BY ts, area) AS weight FROM (
 WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY area, model ORDER BY ts) AS i FROM mkw), e AS (SELECT area, model, ts, i, weight AS s FROM o WHERE i = 1 UNION ALL SELECT o.area, o.model, o.ts, o.i, 0.3 * o.weight + 0.7 * e.s FROM e JOIN o ON o.area = e.area AND o.model = e.model AND o.i = e.i + 1) SELECT * FROM e)""", use="mkw", rd="weight")(
    lambda s, r: C.smooth_weights(stable(MKW(s, r))))
CTX = ["hour_sin", "hour_cos", "is_weekend", "day_of_week"]
ctx = lambda s, r: time_context(tb.filled(s, r))


@query("m29_context_weights")
def m29(s, r):
    d = stable(SC(s, r))
    return C.context_weights_apply(C.context_weights_fit(d, ctx(s, r), CTX, MODELS), ctx(s, r), CTX, 0.05, 0.9)


@query("m30_context_combined")
def m30(s, r):
    d = stable(SC(s, r))
    w = C.context_weights_apply(C.context_weights_fit(d, ctx(s, r), CTX, MODELS, 3), ctx(s, r), CTX, 0.05, 0.9, alpha=0.5)
    return C.combine_weighted(d, stable(w))


query("m31_context_relationships", """SELECT model, weight_std, feature, correlation, rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(correlation) DESC, feature) AS rank FROM (
 SELECT model, stddev_samp(weight) OVER (PARTITION BY model, feature) AS weight_std, feature, corr(x, weight) OVER (PARTITION BY model, feature) AS correlation, row_number() OVER (PARTITION BY model, feature ORDER BY ts, area) AS k FROM (
 SELECT ts, area, model, weight, unnest(['hour', 'day_of_week', 'half']) AS feature, unnest([hour(ts), isodow(ts) - 1, minute(ts) // 30])::DOUBLE AS x FROM mkw)) WHERE k = 1)""", use="mkw", rd="weight_std correlation")(
    lambda s, r: C.context_relationships(tb.filled(s, r).select("ts", "area", F.hour("ts").alias("hour"), F.weekday("ts").alias("day_of_week"), F.floor(F.minute("ts") / 30).alias("half")), MKW(s, r), ["hour", "day_of_week", "half"]))

# --- diversity -----------------------------------------------------------------------
define("pdiv", "pairs", """SELECT model_a, model_b, n, correlation, CASE WHEN n11 * n00 + n10 * n01 = 0 THEN 0 ELSE (n11 * n00 - n10 * n01) / (n11 * n00 + n10 * n01)::DOUBLE END AS q_statistic, (n10 + n01) / n::DOUBLE AS disagreement, n00 / n::DOUBLE AS double_fault, ambiguity FROM (
 SELECT model_a, model_b, count(*) AS n, corr(yhat_a, yhat_b) AS correlation, count(*) FILTER (ca AND cb) AS n11, count(*) FILTER (NOT ca AND NOT cb) AS n00, count(*) FILTER (ca AND NOT cb) AS n10, count(*) FILTER (NOT ca AND cb) AS n01, avg(2 * pow((yhat_a - yhat_b) / 2, 2)) AS ambiguity FROM (
 SELECT *, a <= greatest(abs(y) * 0.05, 1e-6) AS ca, b <= greatest(abs(y) * 0.05, 1e-6) AS cb FROM pairs) GROUP BY 1, 2)""")
query("m32_corr_pairs", "SELECT model_a, model_b, correlation FROM pdiv", use="pdiv", rd="correlation")(lambda s, r: V.corr_pairs(SC(s, r), MODELS))
query("m33_spearman_pairs", """SELECT model_a, model_b, corr(ra, rb) AS spearman FROM (SELECT model_a, model_b, rank() OVER (PARTITION BY model_a, model_b ORDER BY yhat_a) + (count(*) OVER (PARTITION BY model_a, model_b, yhat_a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY model_a, model_b ORDER BY yhat_b) + (count(*) OVER (PARTITION BY model_a, model_b, yhat_b) - 1) / 2.0::DOUBLE AS rb FROM pairs) GROUP BY 1, 2""", use="pairs", rd="spearman")(
    lambda s, r: V.spearman_pairs(stable(SC(s, r)), MODELS))
query("m34_pair_diversity", "SELECT * FROM pdiv", use="pdiv", rd="correlation q_statistic disagreement double_fault ambiguity")(lambda s, r: V.pair_diversity(SC(s, r), MODELS))
query("m35_disagreement", "SELECT model_a, model_b, disagreement FROM pdiv", use="pdiv", rd="disagreement")(lambda s, r: V.disagreement(SC(s, r), MODELS))
query("m36_ambiguity", "SELECT model_a, model_b, ambiguity FROM pdiv", use="pdiv", rd="ambiguity")(lambda s, r: V.ambiguity(SC(s, r), MODELS))
query("m37_diversity_scores", "SELECT *, (correlation + error_based) / 2 AS overall FROM (SELECT *, (q_statistic + disagreement + double_fault + ambiguity) / 4 AS error_based FROM (SELECT 1 - avg(correlation) AS correlation, (1 - avg(q_statistic)) / 2 AS q_statistic, avg(disagreement) AS disagreement, 1 - avg(double_fault) AS double_fault, avg(ambiguity) / max(ambiguity) AS ambiguity FROM pdiv))", use="pdiv",
      rd="correlation q_statistic disagreement double_fault ambiguity error_based overall")(lambda s, r: V.diversity_scores(SC(s, r), MODELS)[0])
define("pcor", "pdiv", "SELECT model_a AS model, correlation AS c FROM pdiv UNION ALL SELECT model_b, correlation FROM pdiv")
query("m37_diversity_ranking", "SELECT model, 1 - avg(c) AS diversity, row_number() OVER (ORDER BY 1 - avg(c) DESC, model) AS rank FROM pcor GROUP BY 1", use="pcor", rd="diversity")(lambda s, r: V.diversity_scores(SC(s, r), MODELS)[1])
query("m38_select_subset")(lambda s, r: V.select_subset(SC(s, r), MODELS))
query("m38_select_subset_backward")(lambda s, r: V.select_subset(SC(s, r), MODELS, "backward", 2))
query("m39_select_by_cluster")(lambda s, r: V.select_by_cluster(SC(s, r), MODELS))
query("m40_select_ensemble")(lambda s, r: N.select_ensemble(SC(s, r), MODELS))
query("m40_select_ensemble_greedy")(lambda s, r: N.select_ensemble(SC(s, r), MODELS, method="greedy"))
query("m41_rolling_performance", """SELECT area, model, avg(mape) AS mean, avg(mape) FILTER (i <= n // 2) AS older, avg(mape) FILTER (i > n // 2) AS newer, count(*) AS n, greatest(least((avg(mape) FILTER (i <= n // 2) - avg(mape) FILTER (i > n // 2)) / (avg(mape) FILTER (i <= n // 2) + 1e-8), 1), -1) AS trend FROM (SELECT *, row_number() OVER (PARTITION BY area, model ORDER BY ts) AS i, count(*) OVER (PARTITION BY area, model) AS n FROM pst) GROUP BY 1, 2""", use="pst", rd="mean older newer trend")(
    lambda s, r: V.rolling_performance(PST(s, r), ["area", "model"]))
query("m42_weight_stability")(lambda s, r: V.weight_stability(SC(s, r)))
query("m43_weight_checks", "SELECT model, weight, weight > 0.8 AS is_extreme, weight > 0 AND weight < 0.05 AS is_tiny, (SELECT var_pop(weight) FROM mw) < 0.01 AS near_uniform FROM mw", use="mw", rd="weight")(
    lambda s, r: V.weight_checks(MW(s, r)))
define("cmean", "scored", "SELECT ts, area, horizon, avg(yhat) AS c FROM scored GROUP BY 1, 2, 3")
COMB = lambda s, r: C.combine_mean(SC(s, r))
define("cdiff", "scored cmean", "SELECT model, abs(y - yhat) - abs(y - c) AS d FROM scored JOIN cmean USING (ts, area, horizon)")
define("csig", "cdiff", f"""SELECT *, mean_diff > 0 AND greatest(t_p, coalesce(wilcoxon_p, 0)) < 0.05 AS combination_better FROM (
 SELECT *, {p_t("t", "(n - 1)")} AS t_p FROM (SELECT model, count(*) AS n, avg(d) AS mean_diff, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM cdiff GROUP BY 1)) LEFT JOIN (
 SELECT model, {p_normal("z")} AS wilcoxon_p FROM (SELECT model, (least(wp, n * (n + 1) / 2.0::DOUBLE - wp) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tie / 48) AS z FROM (
  SELECT model, count(*)::DOUBLE AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS wp, sum(tc) AS tie FROM (
   SELECT model, d, rank() OVER (PARTITION BY model ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model, abs(d)) - 1) / 2.0::DOUBLE AS rk,
    pow(count(*) OVER (PARTITION BY model, abs(d)), 2) - 1 AS tc FROM cdiff WHERE d <> 0) GROUP BY 1))) USING (model)""")
query("m44_combination_significance", "SELECT * FROM csig", use="csig", rd="mean_diff t t_p wilcoxon_p")(
    lambda s, r: V.combination_significance(SC(s, r), COMB(s, r)))
query("m45_weight_drift", """SELECT area, model, mean, std, count(*) FILTER (weight > mean + 2 * std OR weight < mean - 2 * std) AS out_of_control, count(*) FILTER (weight > mean + 2 * std OR weight < mean - 2 * std) > 0 AS drift FROM (
 SELECT *, avg(weight) OVER p AS mean, stddev_pop(weight) OVER p AS std, row_number() OVER (PARTITION BY area, model ORDER BY ts DESC) AS i FROM mkw WINDOW p AS (PARTITION BY area, model)) WHERE i <= 5 GROUP BY 1, 2, 3, 4""", use="mkw", rd="mean std")(
    lambda s, r: V.weight_drift(MKW(s, r), 2.0, ["area", "model"]))
query("m46_combination_gain", "SELECT *, single_mape - combined_mape AS gain, 100 * (single_mape - combined_mape) / single_mape AS gain_pct, single_mape - combined_mape > 0.01 AND combination_better AS passed FROM (SELECT model, combination_better FROM csig) JOIN (SELECT model, 100 * avg(abs((y - yhat) / y)) FILTER (y <> 0) AS single_mape, 100 * avg(abs((y - c) / y)) FILTER (y <> 0) AS combined_mape FROM scored JOIN cmean USING (ts, area, horizon) GROUP BY 1 ORDER BY 2, 1 LIMIT 1) USING (model)", use="scored cmean csig", rd="single_mape combined_mape gain gain_pct")(
    lambda s, r: V.combination_gain(SC(s, r), COMB(s, r)))
query("m47_weight_suite")(lambda s, r: V.weight_suite(stable(SC(s, r)), COMB(s, r), MKW(s, r)))
query("m48_model_profile", """SELECT model, mape, diversity, CASE WHEN model = 'ma' THEN 2.0 ELSE 1.0 END::DOUBLE AS cost FROM (SELECT model, avg(m) AS mape FROM (SELECT model, horizon, 100 * avg(abs((y - yhat) / y)) FILTER (y <> 0) AS m FROM scored GROUP BY 1, 2) GROUP BY 1) JOIN (
 SELECT model, 1 - avg(abs(c)) AS diversity FROM (SELECT model_a AS model, avg(c) AS c FROM (SELECT model_a, model_b, horizon, corr(yhat_a, yhat_b) AS c FROM pairs GROUP BY 1, 2, 3) GROUP BY 1, model_b UNION ALL SELECT model_b, avg(c) FROM (SELECT model_a, model_b, horizon, corr(yhat_a, yhat_b) AS c FROM pairs GROUP BY 1, 2, 3) GROUP BY 1, model_a) GROUP BY 1) USING (model)""", use="scored pairs", rd="mape diversity")(
    lambda s, r: V.model_profile(SC(s, r), MODELS, {"ma": 2.0}))

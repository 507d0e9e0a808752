"""Metrics, tests, comparison, drift, backtests."""

from pyspark.sql import functions as F

from wattline.operators import backtest as B
from wattline.operators import compare as C
from wattline.operators import drift as R
from wattline.operators import metrics as M
from wattline.operators import stattests as S
from wattline.plans.base import query
from wattline.plans.ctes import define
from wattline.plans.q_time import LABEL_SQL
from wattline.sources import tables as tb
from wattline.sources.tables import MODELS

SC = tb.scored
SMAPE = "100 * avg(abs(y - yhat) / greatest((abs(y) + abs(yhat)) / 2, 1e-8))"
R2 = "CASE WHEN var_pop(y) * count(y) < 1e-8 THEN CASE WHEN sum((y-yhat)*(y-yhat)) < 1e-8 THEN 1.0 ELSE 0.0 END ELSE 1 - sum((y-yhat)*(y-yhat)) / (var_pop(y) * count(y)) END"
MET = f"{SMAPE} AS smape, avg(abs(y - yhat)) AS mae, avg((y-yhat)*(y-yhat)) AS mse, sqrt(avg((y-yhat)*(y-yhat))) AS rmse, {R2} AS r2, count(*) AS n"
RD = "smape mae mse rmse r2"
define("met", "scored", f"SELECT area, model, {MET} FROM scored GROUP BY 1, 2")
define("hmet", "scored", f"SELECT model, horizon, {MET} FROM scored GROUP BY 1, 2")
AM = lambda s, r: M.metrics(SC(s, r), ["area", "model"]).drop("n_excluded")

query("e01_metrics", f"SELECT area, model, horizon, {MET}, 0::BIGINT AS n_excluded FROM scored GROUP BY 1, 2, 3", use="scored", rd=RD)(
    lambda s, r: M.metrics(SC(s, r), ["area", "model", "horizon"]))
query("e01_metrics_weighted", "SELECT l_returnflag, 100 * avg(abs(e) / greatest(abs(y), 1e-8)) AS mape, sum(w * abs(e)) / sum(w) AS mae, sum(w * e * e) / sum(w) AS mse, sqrt(sum(w * e * e) / sum(w)) AS rmse, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2, count(*) AS n, 0::BIGINT AS n_excluded FROM (SELECT l_returnflag, l_extendedprice / 1000 AS y, l_quantity * 2 AS yhat, l_extendedprice / 1000 - l_quantity * 2 AS e, l_quantity AS w FROM lineitem) GROUP BY 1", rd="mape mae mse rmse r2")(
    lambda s, r: M.metrics(tb.load(s, r, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 2).alias("yhat"), F.col("l_quantity").alias("w")), ["l_returnflag"], symmetric=False, weight="w"))
query("e02_metrics_nulls_zero", f"SELECT model, {MET.replace('count(*) AS n', 'count(*) AS n')}, count(*) FILTER (raw IS NULL) AS n_excluded FROM (SELECT model, CASE WHEN yhat IS NULL THEN 0 ELSE y END AS y, coalesce(yhat, 0) AS yhat, yhat AS raw FROM fcrows) GROUP BY 1", use="fcrows", rd=RD)(
    lambda s, r: M.metrics(tb.forecast_rows(tb.filled(s, r), 30, 48), ["model"], null_handling="zero"))
query("e03_metrics_basic", "SELECT area, model, avg(yhat - y) AS bias, avg(abs(yhat - y)) AS mae, sqrt(avg((yhat-y)*(yhat-y))) AS rmse, 100 * avg(abs((yhat - y) / y)) FILTER (y <> 0) AS mape_nonzero, count(*) AS n FROM scored GROUP BY 1, 2", use="scored", rd="bias mae rmse mape_nonzero")(
    lambda s, r: M.metrics_basic(SC(s, r), ["area", "model"]))
query("e04_metrics_by_period", f"SELECT *, row_number() OVER (PARTITION BY model ORDER BY smape, period) AS best_rank, row_number() OVER (PARTITION BY model ORDER BY smape DESC, period) AS worst_rank FROM (SELECT model, dayname(ts) AS period, {MET}, 0::BIGINT AS n_excluded FROM scored GROUP BY 1, 2 HAVING count(*) >= 30)", use="scored", rd=RD)(
    lambda s, r: M.metrics_by_period(SC(s, r), "weekday", 30, ["model"]))
_kinds = ["weekday", "season", "hour", "month", "quarter", "day_type", "holiday_proximity"]
query("e05_metrics_cube", " UNION ALL ".join(f"SELECT model, '{k}' AS kind, {LABEL_SQL[k]} AS period, count(*) AS n, {SMAPE} AS smape, avg(abs(y-yhat)) AS mae, sqrt(avg((y-yhat)*(y-yhat))) AS rmse, {R2} AS r2 FROM (SELECT *, ts::DATE AS d FROM scored) GROUP BY ALL" for k in _kinds), use="scored", rd="smape mae rmse r2")(
    lambda s, r: M.metrics_cube(SC(s, r), by=["model"]))
query("e06_bootstrap_ci")(lambda s, r: M.bootstrap_ci(SC(s, r), ["model"], ["area", "ts", "horizon"]))



# Tail probabilities by Simpson's rule over the densities, independent of the closed forms the operators use.
def _simpson(f, start: str, span: float, n: int) -> str:
    h = f"{span / n!r}::DOUBLE"
    weight = f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"list_sum(list_transform(range(0, {n + 1}), lambda i: {weight} * {f(f'({start} + i * {h})')})) * {h} / 3"


def p_t(t: str, df: str) -> str:
    scale = f"exp(lgamma(({df} + 1) / 2.0::DOUBLE) - lgamma({df} / 2.0::DOUBLE)) / sqrt({df} * pi())"
    return f"2 * {scale} * {_simpson(lambda u: f'pow(1 + {u} * {u} / {df}, -({df} + 1) / 2.0::DOUBLE)', f'abs({t})', 60.0, 6000)}"


def p_normal(z: str) -> str:
    return f"2 / sqrt(2 * pi()) * {_simpson(lambda u: f'exp(-{u} * {u} / 2)', f'abs({z})', 40.0, 4000)}"


def p_chi2(x: str, k: str) -> str:
    return f"exp(-lgamma({k} / 2.0::DOUBLE) - {k} / 2.0::DOUBLE * ln(2)) * {_simpson(lambda u: f'pow({u}, {k} / 2.0::DOUBLE - 1) * exp(-{u} / 2)', x, 200.0, 8000)}"


def p_f(x: str, d1: str, d2: str) -> str:
    scale = f"exp(lgamma(({d1} + {d2}) / 2.0::DOUBLE) - lgamma({d1} / 2.0::DOUBLE) - lgamma({d2} / 2.0::DOUBLE)) * pow({d1} / ({d2})::DOUBLE, {d1} / 2.0::DOUBLE)"
    return f"{scale} * {_simpson(lambda u: f'pow({u}, {d1} / 2.0::DOUBLE - 1) * pow(1 + {d1} * {u} / ({d2})::DOUBLE, -({d1} + {d2}) / 2.0::DOUBLE)', x, 60.0, 6000)}"


def p_ks(d: str, n1: str, n2: str) -> str:
    """Tail of the Kolmogorov distribution by its theta series."""
    en = f"sqrt({n1} / ({n1} + {n2})::DOUBLE * {n2})"
    lam = f"greatest({d} * ({en} + 0.12 + 0.11 / {en}), 0.01)"
    return f"1 - sqrt(2 * pi()) / {lam} * list_sum(list_transform(range(0, 500), lambda i: exp(-pow((2 * i + 1) * pi() / {lam}, 2) / 8)))"


def with_p(sql: str, p: str) -> str:
    return f"SELECT *, {p} AS p_value FROM ({sql})"


PAIR = """SELECT a.ts, a.area, a.horizon, a.model AS model_a, b.model AS model_b, a.yhat AS yhat_a, b.yhat AS yhat_b, a.y, abs(a.y - a.yhat) AS a, abs(a.y - b.yhat) AS b, abs(a.y - a.yhat) - abs(a.y - b.yhat) AS d
FROM scored a JOIN scored b ON a.ts = b.ts AND a.area = b.area AND a.horizon = b.horizon AND a.model < b.model"""
define("pairs", "scored", PAIR)
PR = lambda s, r: C.pair_rows(SC(s, r), MODELS).withColumns({"a": F.abs(F.col("y") - F.col("yhat_a")), "b": F.abs(F.col("y") - F.col("yhat_b"))})
PK = ["model_a", "model_b"]
query("e07_paired_t", with_p("SELECT model_a, model_b, count(*) AS n, avg(d) AS mean_diff, stddev_samp(d) AS std_diff, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t, avg(d) / stddev_samp(d) AS effect_size FROM pairs GROUP BY 1, 2", p_t("t", "(n - 1)")), use="pairs", rd="mean_diff std_diff t effect_size p_value")(
    lambda s, r: S.paired_t(PR(s, r), PK))
define("wil", "pairs", """SELECT model_a, model_b, count(*) AS n, sum(CASE WHEN d > 0 THEN rk ELSE 0 END) AS w_plus, sum(tie_c) AS tie FROM (
 SELECT model_a, model_b, d, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1) / 2.0::DOUBLE AS rk,
 pow(count(*) OVER (PARTITION BY model_a, model_b, abs(d)), 2) - 1 AS tie_c FROM pairs WHERE d <> 0) GROUP BY 1, 2""")
query("e08_wilcoxon", with_p("SELECT model_a, model_b, n, w_plus, least(w_plus, n * (n + 1) / 2.0::DOUBLE - w_plus) AS statistic, (least(w_plus, n * (n + 1) / 2.0::DOUBLE - w_plus) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - tie / 48) AS z FROM wil", p_normal("z")), use="wil", rd="w_plus statistic z p_value")(
    lambda s, r: S.wilcoxon(PR(s, r), PK))
LI = lambda s, r: tb.load(s, r, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber")
ISA = lambda: F.col("l_linestatus") == "O"
query("e09_two_sample_t", with_p("""SELECT l_returnflag, na AS n_a, nb AS n_b, ma AS mean_a, mb AS mean_b, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0::DOUBLE / na + 1.0::DOUBLE / nb)) AS statistic FROM (
 SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS na, count(*) FILTER (l_linestatus <> 'O') AS nb, avg(l_extendedprice) FILTER (l_linestatus = 'O') AS ma, avg(l_extendedprice) FILTER (l_linestatus <> 'O') AS mb,
 var_samp(l_extendedprice) FILTER (l_linestatus = 'O') AS va, var_samp(l_extendedprice) FILTER (l_linestatus <> 'O') AS vb FROM lineitem GROUP BY 1)""", p_t("statistic", "(n_a + n_b - 2)")), rd="mean_a mean_b statistic p_value")(
    lambda s, r: S.two_sample(LI(s, r), ["l_returnflag"], "l_extendedprice", ISA()))
MW_Z = """(abs(statistic - n_a / 2.0::DOUBLE * n_b) - 0.5)
 / sqrt(n_a / 12.0::DOUBLE * n_b * ((n_a + n_b + 1) - tie / ((n_a + n_b)::DOUBLE * (n_a + n_b - 1))))"""
query("e09_mann_whitney", f"""SELECT l_returnflag, n_a, n_b, statistic, least({p_normal("z")}, 1) AS p_value FROM (SELECT *, {MW_Z} AS z FROM (
 SELECT l_returnflag, count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, sum(tc) AS tie,
  sum(CASE WHEN a THEN rk ELSE 0 END) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2.0::DOUBLE AS statistic FROM (
  SELECT l_returnflag, l_linestatus = 'O' AS a, pow(count(*) OVER (PARTITION BY l_returnflag, l_quantity), 2) - 1 AS tc,
   rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rk
  FROM lineitem) GROUP BY 1))""", rd="statistic p_value")(
    lambda s, r: S.two_sample(LI(s, r), ["l_returnflag"], "l_quantity", ISA(), "mann_whitney"))
query("e10_effect_size", """SELECT l_returnflag, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS cohens_d FROM (
 SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS na, count(*) FILTER (l_linestatus <> 'O') AS nb, avg(l_quantity) FILTER (l_linestatus = 'O') AS ma, avg(l_quantity) FILTER (l_linestatus <> 'O') AS mb,
 var_samp(l_quantity) FILTER (l_linestatus = 'O') AS va, var_samp(l_quantity) FILTER (l_linestatus <> 'O') AS vb FROM lineitem GROUP BY 1)""", rd="cohens_d")(
    lambda s, r: S.effect_size(LI(s, r), ["l_returnflag"], "l_quantity", ISA()))
query("e10_mean_ci", "SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) / sqrt(count(*)) AS se FROM lineitem GROUP BY 1", rd="mean se")(
    lambda s, r: S.mean_ci(LI(s, r), ["l_returnflag"], "l_quantity").drop("lo", "hi"))
ANOVA = """SELECT l_returnflag, count(*) AS groups, sum(n)::BIGINT AS n, ((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1)) / (sum(ss) / (sum(n) - count(*))) AS statistic FROM (
 SELECT l_returnflag, month(l_shipdate) AS g, count(*) AS n, avg({v}) AS m, var_pop({v}) * count(*) AS ss FROM {src} GROUP BY 1, 2) GROUP BY 1"""
MON = lambda s, r: LI(s, r).withColumn("g", F.month("ts"))
query("e11_anova", with_p(ANOVA.format(v="l_quantity", src="lineitem"), p_f("statistic", "(groups - 1)", "(n - groups)")), rd="statistic p_value")(
    lambda s, r: S.anova(MON(s, r), ["l_returnflag"], "g", "l_quantity"))
query("e12_kruskal", with_p("""SELECT l_returnflag, count(*) AS groups, max(nn) AS n, (12.0::DOUBLE / (max(nn) * (max(nn) + 1.0::DOUBLE)) * sum(r * r / c) - 3 * (max(nn) + 1)) / (1 - max(tie) / (pow(max(nn), 3) - max(nn))) AS statistic FROM (
 SELECT l_returnflag, g, sum(rk) AS r, count(*) AS c, max(nn) AS nn, max(tie) AS tie FROM (
  SELECT *, sum(tc) OVER (PARTITION BY l_returnflag) AS tie FROM (
  SELECT l_returnflag, month(l_shipdate) AS g, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY l_returnflag) AS nn,
   pow(count(*) OVER (PARTITION BY l_returnflag, l_quantity), 2) - 1 AS tc FROM lineitem)) GROUP BY 1, 2) GROUP BY 1""", p_chi2("statistic", "(groups - 1)")), rd="statistic p_value")(
    lambda s, r: S.kruskal(MON(s, r), ["l_returnflag"], "g", "l_quantity"))
query("e13_levene", with_p("WITH z AS (SELECT l_returnflag, l_shipdate, abs(l_quantity - med) AS v FROM lineitem JOIN (SELECT l_returnflag, month(l_shipdate) AS g, median(l_quantity) AS med FROM lineitem GROUP BY 1, 2) USING (l_returnflag) WHERE g = month(l_shipdate)) " + ANOVA.format(v="v", src="z"), p_f("statistic", "(groups - 1)", "(n - groups)")), rd="statistic p_value")(
    lambda s, r: S.levene(MON(s, r), ["l_returnflag"], "g", "l_quantity"))
KS = """SELECT l_returnflag, max(abs(fa - fb)) AS {n}, max(ta)::BIGINT AS n_a, max(tb)::BIGINT AS n_b FROM (
 SELECT l_returnflag, {v}, sum(na) OVER w / sum(na) OVER t AS fa, sum(nb) OVER w / sum(nb) OVER t AS fb, sum(na) OVER t AS ta, sum(nb) OVER t AS tb FROM (
 SELECT l_returnflag, {v}, count(*) FILTER ({a})::DOUBLE AS na, count(*) FILTER (NOT ({a}))::DOUBLE AS nb FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_returnflag ORDER BY {v}), t AS (PARTITION BY l_returnflag)) GROUP BY 1"""
query("e14_ks_two_sample", with_p(KS.format(n="statistic", v="l_extendedprice", a="l_linestatus = 'O'"), p_ks("statistic", "n_a", "n_b")), rd="statistic p_value")(
    lambda s, r: S.ks_two_sample(LI(s, r), ["l_returnflag"], "l_extendedprice", ISA()))
query("e15_normality")(lambda s, r: S.normality(LI(s, r), ["l_returnflag"], "l_extendedprice"))
query("e15_jarque_bera", """SELECT l_returnflag, count(*) AS n, count(*) / 6.0::DOUBLE * (pow(m3 / pow(v, 1.5), 2) + pow(m4 / (v * v) - 3, 2) / 4) AS jb FROM (
 SELECT l_returnflag, avg(v) OVER p AS v, avg(pow(d, 3)) OVER p AS m3, avg(pow(d, 4)) OVER p AS m4 FROM (SELECT l_returnflag, l_extendedprice - avg(l_extendedprice) OVER p AS d, var_pop(l_extendedprice) OVER p AS v FROM lineitem WINDOW p AS (PARTITION BY l_returnflag)) WINDOW p AS (PARTITION BY l_returnflag)) GROUP BY l_returnflag, v, m3, m4""", rd="jb", digits=4)(
    lambda s, r: S.normality(LI(s, r), ["l_returnflag"], "l_extendedprice").select("l_returnflag", "n", "jb"))
query("e16_diebold_mariano", with_p("""SELECT model_a, model_b, count(*) AS n, avg(d) AS mean_loss_diff, avg(d) / sqrt(greatest(var_samp(d) + 2 * (covar_samp(d, d1) + covar_samp(d, d2)), 1e-10) / count(*)) AS dm FROM (
 SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2 FROM (SELECT model_a, model_b, ts, area, horizon, (y - yhat_a) * (y - yhat_a) - (y - yhat_b) * (y - yhat_b) AS d FROM pairs) WINDOW w AS (PARTITION BY model_a, model_b ORDER BY ts, area, horizon)) GROUP BY 1, 2""", p_normal("dm")), use="pairs", rd="mean_loss_diff dm p_value")(
    lambda s, r: S.diebold_mariano(PR(s, r), PK, h=3, tie=["area", "horizon"]))
query("e17_compare_pairs")(lambda s, r: C.compare_pairs(SC(s, r), MODELS))
query("e18_rank_models", "SELECT *, row_number() OVER (PARTITION BY area ORDER BY smape, model) AS rank FROM met", use="met", rd=RD)(
    lambda s, r: C.rank_models(AM(s, r)))
NRM = "(max({c}) OVER p - {c}) / (max({c}) OVER p - min({c}) OVER p + 1e-10)"
query("e19_rank_weighted", f"SELECT *, row_number() OVER (PARTITION BY area ORDER BY score DESC, model) AS rank FROM (SELECT *, (2 * {NRM.format(c='smape')} + {NRM.format(c='rmse')} + (r2 - min(r2) OVER p) / (max(r2) OVER p - min(r2) OVER p + 1e-10)) / 4 AS score FROM met WINDOW p AS (PARTITION BY area))", use="met", rd=RD + " score")(
    lambda s, r: C.rank_weighted(AM(s, r), {"smape": 2.0, "rmse": 1.0, "r2": 1.0}))
query("e20_rank_borda", "SELECT *, row_number() OVER (PARTITION BY area ORDER BY score DESC, model) AS rank FROM (SELECT *, (3 * count(*) OVER p - row_number() OVER (PARTITION BY area ORDER BY smape, model) - row_number() OVER (PARTITION BY area ORDER BY rmse, model) - row_number() OVER (PARTITION BY area ORDER BY r2 DESC, model))::DOUBLE AS score FROM met WINDOW p AS (PARTITION BY area))", use="met", rd=RD + " score")(
    lambda s, r: C.rank_borda(AM(s, r), ["smape", "rmse", "r2"]))
PAR = "NOT EXISTS (SELECT 1 FROM met o WHERE o.area = m.area AND o.smape <= m.smape AND o.rmse <= m.rmse AND o.mae <= m.mae AND (o.smape < m.smape OR o.rmse < m.rmse OR o.mae < m.mae))"
query("e21_pareto", f"SELECT area, model, smape, mae, rmse FROM met m WHERE {PAR}", use="met", rd="smape mae rmse")(
    lambda s, r: C.pareto(AM(s, r), ["smape", "rmse", "mae"]).select("area", "model", "smape", "mae", "rmse"))
query("e21_rank_pareto", f"SELECT area, model, is_pareto, row_number() OVER (PARTITION BY area ORDER BY is_pareto DESC, smape, model) AS rank FROM (SELECT *, {PAR} AS is_pareto FROM met m)", use="met")(
    lambda s, r: C.rank_pareto(AM(s, r), ["smape", "rmse", "mae"]).select("area", "model", "is_pareto", "rank"))
query("e22_recommendation")(lambda s, r: C.recommendation(C.rank_models(M.metrics(SC(s, r), ["model"]).withColumn("area", F.lit("all"))), C.compare_pairs(SC(s, r), MODELS)))
FOLD = "least(floor((rn - 1) / greatest(floor(cnt / 5.0::DOUBLE), 1)), 4)::INTEGER"
query("e23_cv_metrics", f"""SELECT area, model, avg(smape) AS smape_mean, stddev_pop(smape) AS smape_std, avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std, avg(rmse) AS rmse_mean, stddev_pop(rmse) AS rmse_std, count(*) AS folds FROM (
 SELECT area, model, {FOLD} AS fold, {MET} FROM (SELECT *, row_number() OVER (PARTITION BY area, model, horizon ORDER BY ts) AS rn, count(*) OVER (PARTITION BY area, model, horizon) AS cnt FROM scored) GROUP BY 1, 2, 3) WHERE fold >= 1 GROUP BY 1, 2""", use="scored", rd="smape_mean smape_std mae_mean mae_std rmse_mean rmse_std")(
    lambda s, r: C.cv_metrics(SC(s, r), 4))
query("e24_metric_matrix", "SELECT horizon, " + ", ".join(f"max(smape) FILTER (model = '{m}') AS {m}" for m in MODELS) + " FROM hmet GROUP BY 1", use="hmet", rd=" ".join(MODELS))(
    lambda s, r: C.metric_matrix(M.metrics(SC(s, r), ["horizon", "model"]), MODELS))
query("e24_compare_horizons", "SELECT *, 0::BIGINT AS n_excluded, row_number() OVER (PARTITION BY horizon ORDER BY smape, model) AS rank FROM hmet", use="hmet", rd=RD)(
    lambda s, r: C.compare_horizons(SC(s, r)))
query("e25_error_distribution", """SELECT a.*, m3 / pow(v, 1.5) AS skewness, m4 / (v * v) AS kurtosis FROM (
 SELECT model, count(*) AS n, avg(e) AS mean, stddev_samp(e) AS std, """ + ", ".join(f"quantile_cont(e, {p / 100}) AS p{p}" for p in (5, 10, 25, 50, 75, 90, 95)) + """, quantile_cont(e, 0.75) - quantile_cont(e, 0.25) AS iqr FROM errs GROUP BY 1) a
 JOIN (SELECT model, avg(d * d) AS v, avg(d * d * d) AS m3, avg(d * d * d * d) AS m4 FROM (SELECT model, e - avg(e) OVER (PARTITION BY model) AS d FROM errs) GROUP BY 1) b USING (model)""", use="errs", rd="mean std p5 p10 p25 p50 p75 p90 p95 iqr skewness kurtosis")(
    lambda s, r: M.error_distribution(ERR(s, r), ["model"]))
define("errs", "scored", "SELECT ts, area, model, horizon, y - yhat AS e FROM scored")
ERR = lambda s, r: SC(s, r).select("ts", "area", "model", "horizon", (F.col("y") - F.col("yhat")).alias("e"))
OUT_IQR = "SELECT ts, area, model, horizon, e, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, CASE WHEN e < q1 - 1.5 * (q3 - q1) THEN (q1 - 1.5 * (q3 - q1) - e) / (q3 - q1) ELSE (e - q3 - 1.5 * (q3 - q1)) / (q3 - q1) END AS score FROM errs JOIN (SELECT model, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.75) AS q3 FROM errs GROUP BY 1) USING (model) WHERE e < q1 - 1.5 * (q3 - q1) OR e > q3 + 1.5 * (q3 - q1)"
OUT_Z = "SELECT ts, area, model, horizon, e, abs(e - m) / sd AS score FROM errs JOIN (SELECT model, avg(e) AS m, stddev_samp(e) AS sd FROM errs GROUP BY 1) USING (model) WHERE abs(e - m) / sd > 3"
OUT_M = "SELECT ts, area, model, horizon, e, abs(0.6745 * (e - med) / mad) AS score FROM errs JOIN (SELECT model, med, median(abs(e - med)) AS mad FROM errs JOIN (SELECT model, median(e) AS med FROM errs GROUP BY 1) USING (model) GROUP BY 1, 2) USING (model) WHERE abs(0.6745 * (e - med) / mad) > 3.5"
query("e26_outliers_iqr", OUT_IQR, use="errs", rd="e lower upper score")(lambda s, r: M.outliers_iqr(ERR(s, r), ["model"], "e"))
query("e27_outliers_z", OUT_Z, use="errs", rd="e score")(lambda s, r: M.outliers_z(ERR(s, r), ["model"], "e"))
query("e27_outliers_mad", OUT_M, use="errs", rd="e score")(lambda s, r: M.outliers_mad(ERR(s, r), ["model"], "e"))
query("e28_compare_outliers", "SELECT model, method, count(o.model2) AS outliers, n, count(o.model2) / n::DOUBLE AS share FROM (SELECT model, count(*) AS n FROM errs GROUP BY 1) t CROSS JOIN (VALUES ('iqr'), ('zscore'), ('modified_zscore')) v(method) LEFT JOIN (" + " UNION ALL ".join(f"SELECT '{n}' AS method2, model AS model2 FROM ({q})" for n, q in (("iqr", OUT_IQR), ("zscore", OUT_Z), ("modified_zscore", OUT_M))) + ") o ON o.model2 = t.model AND o.method2 = v.method GROUP BY model, method, n", use="errs", rd="share")(
    lambda s, r: M.compare_outliers(ERR(s, r), ["model"], "e"))
query("e29_metrics_by_horizon", "SELECT *, 0::BIGINT AS n_excluded, row_number() OVER (PARTITION BY model ORDER BY round(smape, 6), horizon) AS rank FROM hmet", use="hmet", rd=RD)(
    lambda s, r: M.metrics_by_horizon(SC(s, r)))


def _deg(kind, x, y, fit, a):
    return f"""SELECT model, '{kind}' AS growth, {a} AS intercept, b AS rate, CASE WHEN tot > 1e-10 THEN 1 - res / tot ELSE 1 END AS r_squared, CASE WHEN b > 0.01 THEN 'degrading' WHEN b < -0.01 THEN 'improving' ELSE 'stable' END AS pattern FROM (
 SELECT model, a, b, sum(pow(smape - {fit}, 2)) AS res, var_pop(smape) * count(*) AS tot FROM hmet JOIN (SELECT model, regr_intercept({y}, {x}) AS a, regr_slope({y}, {x}) AS b FROM hmet GROUP BY 1) USING (model) GROUP BY 1, 2, 3)"""


for _k, _args in {"linear": ("horizon", "smape", "(a + b * horizon)", "a"), "exponential": ("horizon", "ln(smape)", "exp(a + b * horizon)", "exp(a)"), "power_law": ("ln(horizon)", "ln(smape)", "exp(a + b * ln(horizon))", "exp(a)")}.items():
    query(f"e30_degradation_{_k}", _deg(_k, *_args), use="hmet", rd="intercept rate r_squared")(
        lambda s, r, k=_k: M.degradation(M.metrics(SC(s, r), ["model", "horizon"]), model=k))
query("e31_skill_persistence", "SELECT area, model, horizon, 'persistence' AS baseline, 1 - avg((yhat-y)*(yhat-y)) / avg((b-y)*(b-y)) AS skill FROM (SELECT *, coalesce(lag(y) OVER (PARTITION BY area, model, horizon ORDER BY ts), y) AS b FROM scored) GROUP BY 1, 2, 3", use="scored", rd="skill")(
    lambda s, r: M.skill(SC(s, r), ["area", "model", "horizon"], step=30))
query("e31_skill_climatology", "SELECT area, model, horizon, 'climatology' AS baseline, 1 - avg((yhat-y)*(yhat-y)) / var_pop(y) AS skill FROM scored GROUP BY 1, 2, 3", use="scored", rd="skill")(
    lambda s, r: M.skill(SC(s, r), ["area", "model", "horizon"], baseline="climatology"))
query("e32_compare_two_horizons", "SELECT model, a AS value_a, b AS value_b, b - a AS difference, b / a AS ratio FROM (SELECT model, max(smape) FILTER (horizon = 1) AS a, max(smape) FILTER (horizon = 3) AS b FROM hmet GROUP BY 1)", use="hmet", rd="value_a value_b difference ratio")(
    lambda s, r: M.compare_two_horizons(M.metrics(SC(s, r), ["model", "horizon"]), 1, 3))
define("bcmp", "scored", f"SELECT a.area, a.model, a.smape, b.smape AS baseline_smape, a.smape - b.smape AS difference, a.smape - b.smape <= 0.5 AS within_tolerance FROM (SELECT area, model, {SMAPE} AS smape FROM scored WHERE horizon > 1 GROUP BY 1, 2) a JOIN (SELECT area, model, {SMAPE} AS smape FROM scored WHERE horizon = 1 GROUP BY 1, 2) b USING (area, model)")


def _bcmp(s, r):
    d = SC(s, r)
    return M.baseline_compare(M.metrics(d.where("horizon > 1"), ["area", "model"]), M.metrics(d.where("horizon = 1"), ["area", "model"]), 0.5)


query("e33_baseline_compare", "SELECT * FROM bcmp", use="bcmp", rd="smape baseline_smape difference")(_bcmp)
query("e33_baseline_summary", "SELECT avg(difference) AS mean_difference, stddev_pop(difference) AS std_difference, max(difference) AS max_difference, min(difference) AS min_difference, avg(within_tolerance::INTEGER) AS pass_rate, count(*) AS total_comparisons, count(*) FILTER (NOT within_tolerance) AS violations FROM bcmp", use="bcmp", rd="mean_difference std_difference max_difference min_difference pass_rate")(
    lambda s, r: M.baseline_summary(_bcmp(s, r)))
query("e34_tolerance_check", "SELECT model, horizon, smape, ref AS reference, abs(smape - ref) / ref AS relative_difference, abs(smape - ref) / ref <= 0.02 AS within_tolerance FROM hmet JOIN (SELECT model, horizon - 1 AS h, smape AS ref FROM hmet) x USING (model) WHERE x.h = horizon", use="hmet", rd="smape reference relative_difference")(
    lambda s, r: M.tolerance_check(M.metrics(SC(s, r), ["model", "horizon"]), M.metrics(SC(s, r), ["model", "horizon"]).withColumn("horizon", F.col("horizon") - 1), ["model", "horizon"], "smape"))
query("e35_performance_patterns", " UNION ALL ".join(f"SELECT model, '{k}' AS kind, ({e})::VARCHAR AS value, count(*) AS n, {SMAPE} AS smape, avg(abs(y - yhat)) AS mae FROM scored GROUP BY ALL" for k, e in {"season": "((month(ts) % 12) // 3) + 1", "area": "area", "month": "month(ts)"}.items()), use="scored", rd="smape mae")(
    lambda s, r: M.performance_patterns(SC(s, r)))
DM_ = lambda s, r: M.metrics(SC(s, r).withColumn("day", F.date_trunc("day", "ts")), ["model", "day"]).select("model", F.col("day").cast("timestamp_ntz").alias("ts"), "smape")
define("dmet", "scored", f"SELECT model, date_trunc('day', ts)::TIMESTAMP AS ts, {SMAPE} AS smape FROM scored GROUP BY 1, 2")
query("e36_metric_stability", "SELECT model, avg(smape) AS mean, stddev_pop(smape) AS std, stddev_pop(smape) / avg(smape) AS cv, max(smape) - min(smape) AS range, count(smape) AS n FROM dmet GROUP BY 1", use="dmet", rd="mean std cv range")(
    lambda s, r: M.metric_stability(DM_(s, r), ["model"]))
query("e36_outlier_periods", "SELECT model, ts, smape, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM dmet JOIN (SELECT model, quantile_cont(smape, 0.25) AS q1, quantile_cont(smape, 0.75) AS q3 FROM dmet GROUP BY 1) USING (model) WHERE smape < q1 - 1.5 * (q3 - q1) OR smape > q3 + 1.5 * (q3 - q1)", use="dmet", rd="smape lower upper")(
    lambda s, r: M.outliers_iqr(DM_(s, r), ["model"], "smape").drop("score"))
query("e37_evaluation_summary", "SELECT 'metrics' AS section, area || '/' || model AS key, u.measure, u.value FROM met, (VALUES ('smape'), ('rmse')) v(m), LATERAL (SELECT v.m AS measure, CASE WHEN v.m = 'smape' THEN smape ELSE rmse END AS value) u UNION ALL SELECT 'ranking', area || '/' || model, 'rank', row_number() OVER (PARTITION BY area ORDER BY smape, model) FROM met", use="met", rd="value")(
    lambda s, r: C.evaluation_summary({"metrics": (AM(s, r), ["area", "model"], ["smape", "rmse"]), "ranking": (C.rank_models(AM(s, r)), ["area", "model"], ["rank"])}))

# --- drift ------------------------------------------------------------------------
REF = lambda: F.col("ts") < F.lit("1998-06-01").cast("timestamp_ntz")
HIST = """SELECT l_returnflag, bin, count(*) FILTER (ref)::DOUBLE AS ref, count(*) FILTER (NOT ref)::DOUBLE AS test FROM (
 SELECT l_returnflag, ref, least(floor((v - a) / w), 9)::INTEGER AS bin FROM (SELECT l_returnflag, l_shipdate < TIMESTAMP '1998-06-01' AS ref, l_extendedprice AS v FROM lineitem)
 JOIN (SELECT l_returnflag, lo - (hi - lo) * 0.01 - 1e-10 AS a, (hi - lo + 2 * ((hi - lo) * 0.01 + 1e-10)) / 10 AS w FROM (SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1)) USING (l_returnflag)) GROUP BY 1, 2"""
define("hist", "", HIST)
define("shares", "hist", "SELECT l_returnflag, ref, test, sum(ref) OVER p AS nr, sum(test) OVER p AS nt, (ref + 1e-10) / (sum(ref) OVER p + 1e-9) AS p, (test + 1e-10) / (sum(test) OVER p + 1e-9) AS q FROM hist WINDOW p AS (PARTITION BY l_returnflag)")
query("r01_psi", "SELECT l_returnflag, sum((q - p) * ln(q / p)) AS score, sum((q - p) * ln(q / p)) >= 0.1 AS drift_detected FROM shares GROUP BY 1", use="shares", rd="score")(
    lambda s, r: R.psi(LI(s, r), ["l_returnflag"], "l_extendedprice", REF()))
query("r02_kl", "SELECT l_returnflag, sum((p - q) * ln(p / q)) / 2 AS score, sum((p - q) * ln(p / q)) / 2 >= 0.1 AS drift_detected FROM shares GROUP BY 1", use="shares", rd="score")(
    lambda s, r: R.kl(LI(s, r), ["l_returnflag"], "l_extendedprice", REF()))
DETECT = "SELECT *, p_value < 0.05 AS drift_detected FROM ({})"
query("r03_chi_square", DETECT.format(with_p("SELECT l_returnflag, sum(pow(test * nr / nt + 1e-10 - (ref + 1e-10), 2) / (ref + 1e-10)) AS score FROM shares GROUP BY 1", p_chi2("score", "9"))), use="shares", rd="score p_value")(
    lambda s, r: R.chi_square(LI(s, r), ["l_returnflag"], "l_extendedprice", REF()))
query("r04_wasserstein", """SELECT l_returnflag, d AS raw_distance, d / sd AS score, d / sd >= 0.5 AS drift_detected FROM (SELECT l_returnflag, sum(abs(fa - fb) * (nv - l_extendedprice)) AS d FROM (
 SELECT l_returnflag, l_extendedprice, lead(l_extendedprice) OVER w AS nv, sum(na) OVER w / sum(na) OVER t AS fa, sum(nb) OVER w / sum(nb) OVER t AS fb FROM (
 SELECT l_returnflag, l_extendedprice, count(*) FILTER (l_shipdate < TIMESTAMP '1998-06-01')::DOUBLE AS na, count(*) FILTER (NOT l_shipdate < TIMESTAMP '1998-06-01')::DOUBLE AS nb FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice), t AS (PARTITION BY l_returnflag)) GROUP BY 1)
 JOIN (SELECT l_returnflag, stddev_samp(l_extendedprice) AS sd FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1) USING (l_returnflag)""", rd="raw_distance score")(
    lambda s, r: R.wasserstein(LI(s, r), ["l_returnflag"], "l_extendedprice", REF()))
KS_REF = KS.format(n="score", v="l_extendedprice", a="l_shipdate < TIMESTAMP '1998-06-01'")
query("r05_ks_drift", f"SELECT * EXCLUDE (n_a, n_b) FROM ({DETECT.format(with_p(KS_REF, p_ks('score', 'n_a', 'n_b')))})", rd="score p_value")(
    lambda s, r: R.ks_drift(LI(s, r), ["l_returnflag"], "l_extendedprice", REF()))
SREF = lambda: F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
query("r06_cusum", """WITH s AS (SELECT area, avg(load) AS m, stddev_samp(load) AS sd FROM filled WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
 c AS (SELECT area, ts, sd, sum(load - m - 0.5 * sd) OVER w AS cp, sum(m - load - 0.5 * sd) OVER w AS cn FROM filled JOIN s USING (area) WHERE ts >= TIMESTAMP '2024-01-16' WINDOW w AS (PARTITION BY area ORDER BY ts)),
 x AS (SELECT area, sd, greatest(cp - least(0, min(cp) OVER w), cn - least(0, min(cn) OVER w), 0) AS p FROM c WINDOW w AS (PARTITION BY area ORDER BY ts))
 SELECT area, max(p) AS max_cusum, max(p) / max(sd) AS score, max(p) / max(sd) >= 5 AS drift_detected FROM x GROUP BY 1""".replace("WITH s AS", "SELECT * FROM (WITH s AS") + ")", use="filled", rd="max_cusum score")(
    lambda s, r: R.cusum(tb.filled(s, r), ["area"], "load", SREF()))
query("r07_page_hinkley", """SELECT area, max(u - m) AS score, max(u - m) >= 50 AS drift_detected FROM (SELECT area, u, min(u) OVER (PARTITION BY area ORDER BY ts) AS m FROM (
 SELECT area, ts, sum(load - mean - 0.005) OVER (PARTITION BY area ORDER BY ts) AS u FROM (SELECT area, ts, load, avg(load) OVER (PARTITION BY area ORDER BY ts) AS mean FROM filled))) GROUP BY 1""", use="filled", rd="score")(
    lambda s, r: R.page_hinkley(tb.filled(s, r), ["area"], "load"))
query("r08_drift_alerts", "SELECT l_returnflag, score, true AS drift_detected, CASE WHEN score < 0.1 THEN 'low' WHEN score < 0.2 THEN 'medium' WHEN score < 0.3 THEN 'high' ELSE 'critical' END AS severity, CASE WHEN score < 0.1 THEN 'keep monitoring' WHEN score < 0.2 THEN 'watch closely' WHEN score < 0.3 THEN 'plan retraining, check data quality' ELSE 'retrain now' END AS action FROM (SELECT l_returnflag, sum((q - p) * ln(q / p)) AS score FROM shares2 GROUP BY 1) WHERE score >= 0.1", use="shares2", rd="score")(
    lambda s, r: R.drift_alerts(R.psi(LI(s, r).withColumn("l_extendedprice", F.when(REF(), F.col("l_extendedprice")).otherwise(F.col("l_extendedprice") * 1.5)), ["l_returnflag"], "l_extendedprice", REF())))
define("hist2", "", HIST.replace("l_extendedprice AS v FROM lineitem", "CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN l_extendedprice ELSE l_extendedprice * 1.5 END AS v FROM lineitem").replace("min(l_extendedprice) AS lo, max(l_extendedprice) AS hi", "min(CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN l_extendedprice ELSE l_extendedprice * 1.5 END) AS lo, max(CASE WHEN l_shipdate < TIMESTAMP '1998-06-01' THEN l_extendedprice ELSE l_extendedprice * 1.5 END) AS hi"))
define("shares2", "hist2", "SELECT l_returnflag, ref, test, (ref + 1e-10) / (sum(ref) OVER p + 1e-9) AS p, (test + 1e-10) / (sum(test) OVER p + 1e-9) AS q FROM hist2 WINDOW p AS (PARTITION BY l_returnflag)")


def _ksf(c):
    return f"""SELECT '{c}' AS feature, max(abs(fa - fb)) AS score, max(ta)::BIGINT AS n_a, max(tb)::BIGINT AS n_b FROM (
 SELECT sum(na) OVER (ORDER BY v) / sum(na) OVER () AS fa, sum(nb) OVER (ORDER BY v) / sum(nb) OVER () AS fb, sum(na) OVER () AS ta, sum(nb) OVER () AS tb FROM (
 SELECT {c} AS v, count(*) FILTER (l_shipdate < TIMESTAMP '1998-06-01')::DOUBLE AS na, count(*) FILTER (NOT l_shipdate < TIMESTAMP '1998-06-01')::DOUBLE AS nb FROM lineitem GROUP BY 1))"""


define("ksmulti", "", DETECT.format(with_p(" UNION ALL ".join(_ksf(c) for c in ("l_quantity", "l_discount", "l_tax")), p_ks("score", "n_a", "n_b"))))
query("r09_drift_multi", "SELECT feature, score, p_value, drift_detected FROM ksmulti", use="ksmulti", rd="score p_value")(
    lambda s, r: R.drift_multi(LI(s, r), ["l_quantity", "l_discount", "l_tax"], REF(), "ks_test")[0])
query("r09_drift_overall", "SELECT max(score) AS max_score, arg_max(feature, score) AS worst_feature, bool_or(drift_detected) AS any_drift FROM ksmulti", use="ksmulti", rd="max_score")(
    lambda s, r: R.drift_multi(LI(s, r), ["l_quantity", "l_discount", "l_tax"], REF(), "ks_test")[1])
PERF = """SELECT model, score, n_a, n_b, rm AS reference_mean, tm AS test_mean, (tm - rm) / (rm + 1e-10) AS mean_increase, CASE WHEN (tm - rm) / (rm + 1e-10) > 0.2 THEN 'high' WHEN (tm - rm) / (rm + 1e-10) > 0.1 THEN 'medium' END AS alert FROM (
 SELECT model, max(abs(fa - fb)) AS score, max(ta)::BIGINT AS n_a, max(tb)::BIGINT AS n_b FROM (
  SELECT model, sum(na) OVER w / sum(na) OVER t AS fa, sum(nb) OVER w / sum(nb) OVER t AS fb, sum(na) OVER t AS ta, sum(nb) OVER t AS tb FROM (SELECT model, abs(e) AS v, count(*) FILTER (ts < TIMESTAMP '2024-01-16')::DOUBLE AS na, count(*) FILTER (NOT ts < TIMESTAMP '2024-01-16')::DOUBLE AS nb FROM errs GROUP BY 1, 2) WINDOW w AS (PARTITION BY model ORDER BY v), t AS (PARTITION BY model)) GROUP BY 1)
 JOIN (SELECT model, avg(abs(e)) FILTER (ts < TIMESTAMP '2024-01-16') AS rm, avg(abs(e)) FILTER (NOT ts < TIMESTAMP '2024-01-16') AS tm FROM errs GROUP BY 1) USING (model)"""
query("r10_performance_drift", f"SELECT * EXCLUDE (n_a, n_b), p_value < 0.05 OR mean_increase > 0.1 AS drift_detected FROM ({with_p(PERF, p_ks('score', 'n_a', 'n_b'))})", use="errs",
      rd="score p_value reference_mean test_mean mean_increase")(
    lambda s, r: R.performance_drift(ERR(s, r).withColumn("ae", F.abs("e")), ["model"], "ae", SREF()))
query("r11_drift_summary")(lambda s, r: R.drift_summary(tb.filled(s, r), ["area"], "load", SREF()))
query("r12_ref_stats", "SELECT l_returnflag, avg(l_extendedprice) AS mean, stddev_samp(l_extendedprice) AS std, min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(*) AS n_samples, median(l_extendedprice) AS median, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.75) AS q75 FROM lineitem GROUP BY 1", rd="mean std min max median q25 q75", digits=5)(
    lambda s, r: R.ref_stats(LI(s, r), ["l_returnflag"], "l_extendedprice"))
query("r13_metric_drift", """SELECT model, lm - fm AS drift_absolute, (lm - fm) / fm * 100 AS drift_percentage, abs((lm - fm) / fm * 100) > 10 AS is_significant, ls - fs AS variance_drift, ls > fs AS is_increasing FROM (SELECT model, avg(smape) FILTER (i <= 7) AS fm, avg(smape) FILTER (i > n - 7) AS lm, stddev_samp(smape) FILTER (i <= 7) AS fs, stddev_samp(smape) FILTER (i > n - 7) AS ls FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts) AS i, count(*) OVER (PARTITION BY model) AS n FROM dmet) GROUP BY 1)""", use="dmet", rd="drift_absolute drift_percentage variance_drift")(
    lambda s, r: R.metric_drift(DM_(s, r), ["model"], "smape"))
query("r14_metric_trend", "SELECT model, b AS trend_slope, b < 0 AS is_improving, b > 0 AS is_degrading FROM (SELECT model, regr_slope(smape, i) AS b FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY ts)::DOUBLE AS i FROM dmet) GROUP BY 1)", use="dmet", rd="trend_slope")(
    lambda s, r: R.metric_trend(DM_(s, r), ["model"], "smape"))
query("r15_metric_anomalies", "SELECT model, ts, smape FROM dmet JOIN (SELECT model, avg(smape) AS m, stddev_pop(smape) AS sd FROM dmet GROUP BY 1) USING (model) WHERE abs(smape - m) > 2 * sd", use="dmet", rd="smape")(
    lambda s, r: R.metric_anomalies(DM_(s, r), ["model"], "smape"))

# --- backtests ---------------------------------------------------------------------
define("win", "", "SELECT w::INTEGER AS window_id, (DATE '1995-01-01' + w::INTEGER * 30)::DATE AS train_start, (DATE '1995-01-01' + w::INTEGER * 30 + 365)::DATE AS train_end, (DATE '1995-01-01' + w::INTEGER * 30 + 373)::DATE AS test_end FROM range(0, ((DATE '2001-07-01' - DATE '1995-01-01' - 373) // 30) + 1) t(w)")
WIN = lambda s: B.backtest_windows(s, "1995-01-01", "2001-07-01", 30, 8, 365)
define("bt", "win dfilled", f"""SELECT window_id, area, horizon, model, {MET} FROM (
 SELECT w.window_id, x.area, (x.ts::DATE - w.train_end)::INTEGER AS horizon, x.load AS y, unnest(['profile', 'naive']) AS model, unnest([p.m, l.load]) AS yhat
 FROM win w JOIN dfilled x ON x.ts::DATE BETWEEN w.train_end AND w.test_end
 JOIN (SELECT window_id, area, avg(load) AS m FROM win JOIN dfilled ON ts::DATE >= train_start AND ts::DATE < train_end GROUP BY 1, 2) p ON p.window_id = w.window_id AND p.area = x.area
 JOIN dfilled l ON l.area = x.area AND l.ts::DATE = w.train_end - 1) GROUP BY 1, 2, 3, 4""")
BT = lambda s, r: B.backtest(tb.daily_filled(s, r), WIN(s), 30, 365, slots=1)
query("t01_backtest_windows", "SELECT w.*, count(*) AS n FROM win w JOIN orders ON o_orderdate >= train_start AND o_orderdate < train_end GROUP BY ALL", use="win")(
    lambda s, r: tb.load(s, r, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    .join(WIN(s).withColumn("d", F.explode(F.sequence("train_start", F.date_sub("train_end", 1)))), "d")
    .groupBy("window_id", "train_start", "train_end", "test_end").agg(F.sum("c").alias("n")))
query("t02_walk_forward", """SELECT period_id, train_start, train_end, test_start, test_end, count(*) AS n FROM (SELECT ((ts0 - DATE '1995-01-01') // 60)::INTEGER AS period_id, ts0 - 365 AS train_start, ts0 - 1 AS train_end, ts0 AS test_start, least(ts0 + 59, DATE '2001-07-01') AS test_end FROM (
 SELECT unnest(generate_series(DATE '1996-01-01', DATE '2001-07-01', INTERVAL 60 DAY))::DATE AS ts0)) JOIN orders ON o_orderdate >= test_start AND o_orderdate <= test_end GROUP BY ALL""")(
    lambda s, r: tb.load(s, r, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    .join(B.walk_forward(s, "1995-01-01", "2001-07-01", 60, 365).withColumn("d", F.explode(F.sequence("test_start", "test_end"))), "d")
    .groupBy("period_id", "train_start", "train_end", "test_start", "test_end").agg(F.sum("c").alias("n")))
query("t03_backtest", "SELECT * FROM bt", use="bt", rd=RD)(BT)
BTX = " UNION ALL ".join(f"SELECT area, ts::DATE AS day, {h - 1} AS horizon, load AS y, lag(load, {h}) OVER w AS last, lag(load, {B.week_lag(h)}) OVER w AS week FROM dfilled WINDOW w AS (PARTITION BY area ORDER BY ts)" for h in range(1, 10))
define("btx", "dfilled", f"SELECT * FROM ({BTX}) WHERE last IS NOT NULL AND week IS NOT NULL")
query("t03_backtest_fitted", """SELECT f.window_id, f.area, f.horizon, f.n, t.y, f.my + f.b1 * (t.last - f.ml) + f.b2 * (t.week - f.mw) AS yhat, abs(t.y - (f.my + f.b1 * (t.last - f.ml) + f.b2 * (t.week - f.mw))) AS abs_error FROM (
 SELECT *, (sly * (sww + 1) - swy * slw) / ((sll + 1) * (sww + 1) - slw * slw) AS b1, (swy * (sll + 1) - sly * slw) / ((sll + 1) * (sww + 1) - slw * slw) AS b2 FROM (
  SELECT window_id, train_end, area, horizon, count(*) AS n, avg(y) AS my, avg(last) AS ml, avg(week) AS mw, covar_pop(y, last) * count(*) AS sly, covar_pop(y, week) * count(*) AS swy, covar_pop(last, week) * count(*) AS slw,
   var_pop(last) * count(*) AS sll, var_pop(week) * count(*) AS sww FROM win JOIN btx ON day >= train_start AND day < train_end GROUP BY 1, 2, 3, 4) WHERE n > 3) f
 JOIN btx t ON t.area = f.area AND t.horizon = f.horizon AND t.day = f.train_end + f.horizon""", use="win btx", rd="y yhat abs_error", digits=3)(
    lambda s, r: B.backtest_fitted(tb.daily_filled(s, r), WIN(s), 8))
T4 = ", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in B.SUMMARY)
query("t04_backtest_summary", f"SELECT model, horizon, area, count(*) AS n, {T4}, CASE WHEN horizon IS NOT NULL THEN 'horizon' WHEN area IS NOT NULL THEN 'area' ELSE 'overall' END AS scope FROM bt GROUP BY GROUPING SETS ((model), (model, horizon), (model, area))", use="bt",
      rd=" ".join(f"{c}_{x}" for c in B.SUMMARY for x in ("mean", "std", "min", "max")))(lambda s, r: B.backtest_summary(BT(s, r)))
query("t05_backtest_targets", "SELECT model, avg(smape) AS smape, avg(smape) <= 15 AS smape_ok FROM bt GROUP BY 1", use="bt", rd="smape")(lambda s, r: B.backtest_targets(BT(s, r)))

"""Hierarchy, reconciliation, losses."""

from pyspark.sql import functions as F

from wattline.functions.ordered import stable
from wattline.operators import hierarchy as H
from wattline.operators import losses as L
from wattline.operators import reconcile as R
from wattline.plans.base import query
from wattline.plans.ctes import define
from wattline.sources import tables as tb

E = tb.hierarchy_edges
define("nodes", "edges", "SELECT 'TOTAL' AS node, 0 AS level, 'aggregate' AS node_type UNION ALL SELECT r_name, 1, 'aggregate' FROM region UNION ALL SELECT n_name, 2, 'bottom' FROM nation")
define("smat", "", "SELECT n_name AS node, n_name AS leaf, 1.0::DOUBLE AS w FROM nation UNION ALL SELECT r_name, n_name, 1.0 FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'TOTAL', n_name, 1.0 FROM nation")
define("nact", "dfilled smat", "SELECT ts, node, sum(w * load) AS y FROM dfilled JOIN smat ON leaf = area GROUP BY 1, 2")
define("nall", "nact nodes", """SELECT ts, node, level, CASE level WHEN 0 THEN CASE WHEN count(y) OVER (PARTITION BY node ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) = 6 THEN avg(y) OVER (PARTITION BY node ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) END
 WHEN 1 THEN lag(y, 7) OVER (PARTITION BY node ORDER BY ts) ELSE lag(y) OVER (PARTITION BY node ORDER BY ts) END AS yhat FROM nact JOIN nodes USING (node)""")
define("nfc", "nall", "SELECT ts, node, yhat FROM nall WHERE yhat IS NOT NULL AND ts IN (SELECT ts FROM nall WHERE yhat IS NOT NULL GROUP BY ts HAVING count(*) = 31)")


def _actuals(s, r, S):
    leaf = tb.daily_filled(s, r).select("ts", F.col("area").alias("node"), F.col("load").alias("yhat"))
    return stable(R.bottom_up(leaf, S).withColumnRenamed("yhat", "y"))


def node_actuals(s, r):
    return _actuals(s, r, H.summation_matrix(E(s, r)))


def forecasts_and_actuals(s, r, whole=True):
    """Incoherent base forecasts (6-day mean at the top, week lag for regions, day lag for
    nations) and the actuals of every node.

    ``whole``: only time stamps with a forecast of every node, which is what the SQL states. Otherwise
    every node of every time stamp, null where there is no forecast."""
    from wattline.functions.ordered import bounded

    e = E(s, r)
    c = stable(H.closure(e))
    y = _actuals(s, r, H.leaf_weights(c, e))

    def make(w):
        past = w.rowsBetween(-6, -1)
        top = F.when(F.count("y").over(past) == 6, F.avg("y").over(past))
        return {"yhat": F.when(F.col("level") == 0, top).when(F.col("level") == 1, F.lag("y", 7).over(w)).otherwise(F.lag("y").over(w))}

    nodes = stable(H.levels(c))
    f = bounded(y.join(nodes, "node"), ["node"], "ts", make, back=7, step=tb.DAY).where("yhat is not null").select("ts", "node", "yhat")
    if not whole:
        return stable(y.select("ts").distinct().crossJoin(nodes.select("node")).join(f, ["ts", "node"], "left")), y
    full = f.groupBy("ts").agg(F.count(F.lit(1)).alias("n")).join(nodes.agg(F.count(F.lit(1)).alias("n")), "n", "left_semi")
    return stable(f.join(full, "ts", "left_semi")), y


def every_fc(s, r):
    return forecasts_and_actuals(s, r, whole=False)


def node_fc(s, r):
    return forecasts_and_actuals(s, r)[0]


query("h01_hierarchy", "SELECT node, level, node_type FROM nodes", use="nodes")(lambda s, r: H.hierarchy(E(s, r)))


@query("h01_from_config", "SELECT node, level, node_type FROM nodes UNION ALL SELECT r_name || '_Losses', NULL, 'calculated' FROM region", use="nodes")
def h01_config(s, r):
    """The tree from a configuration: a region and its nations as lists, and a loss node for each region."""
    rows = tb.load(s, r, "nation").join(tb.load(s, r, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("n")).collect()
    return H.from_config(s, "TOTAL", {x["r_name"]: x["n"] for x in rows}, [f"{x['r_name']}_Losses" for x in rows])[0]


query("h02_add_node", "SELECT node, level, node_type FROM nodes UNION ALL SELECT 'NATION_X', 2, 'bottom'", use="nodes")(
    lambda s, r: H.add_node(H.hierarchy(E(s, r)), E(s, r), "NATION_X", "ASIA")[0])
query("h03_summation_matrix", "WITH RECURSIVE e AS (SELECT 'TOTAL' AS parent, r_name AS child FROM region UNION ALL SELECT r_name, n_name FROM nation JOIN region ON r_regionkey = n_regionkey), c AS (SELECT node, node AS d FROM (SELECT parent AS node FROM e UNION SELECT child FROM e) UNION ALL SELECT c.node, e.child FROM c JOIN e ON e.parent = c.d) SELECT node, d AS leaf, 1.0::DOUBLE AS w FROM c WHERE d NOT IN (SELECT parent FROM e)", rd="")(
    lambda s, r: H.summation_matrix(E(s, r)))
query("h04_paths", "SELECT 'TOTAL' AS node, NULL::VARCHAR AS parent, 0 AS level, 'TOTAL' AS path UNION ALL SELECT r_name, 'TOTAL', 1, r_name || '/TOTAL' FROM region UNION ALL SELECT n_name, r_name, 2, n_name || '/' || r_name || '/TOTAL' FROM nation JOIN region ON r_regionkey = n_regionkey")(
    lambda s, r: H.paths(E(s, r)))
query("h04_children", "SELECT n_name AS child, 1.0::DOUBLE AS weight FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'")(
    lambda s, r: H.children(E(s, r), "ASIA"))
query("h05_validate_hierarchy", "SELECT unnest(['one_root', 'no_cycle', 'no_orphan', 'known_nodes', 'single_parent', 'complete_attributes', 'summation_rows']) AS check, 0::BIGINT AS problems, true AS ok")(
    lambda s, r: H.validate_hierarchy(H.hierarchy(E(s, r)), E(s, r)))
define("ksum", "nfc edges", "SELECT f.ts, f.node, f.yhat, sum(c.yhat) AS expected FROM nfc f JOIN edges e ON e.parent = f.node JOIN nfc c ON c.node = e.child AND c.ts = f.ts GROUP BY 1, 2, 3")
query("h06_validate_node_fc", "SELECT * , problems = 0 AS ok FROM (SELECT 'missing_nodes' AS check, 0::BIGINT AS problems UNION ALL SELECT 'not_finite', 0 UNION ALL SELECT 'negative', count(*) FILTER (yhat < 0) FROM nfc UNION ALL SELECT 'incoherent', count(*) FILTER (abs(yhat - expected) > 1e-6 * greatest(1, abs(yhat))) FROM ksum)", use="nfc ksum")(
    lambda s, r: H.validate_node_fc(node_fc(s, r), H.hierarchy(E(s, r)), E(s, r)))
query("h07_bottom_up", "SELECT ts, node, y FROM nact", use="nact", rd="y", digits=4)(node_actuals)
define("bu", "nfc smat", "SELECT f.ts, s.node, sum(s.w * f.yhat) AS sm FROM nfc f JOIN smat s ON s.leaf = f.node GROUP BY 1, 2")
query("h08_coherence", "SELECT sqrt(sum((yhat - sm) * (yhat - sm))) / sqrt(sum(yhat * yhat)) AS coherence_error, max(abs(yhat - sm)) AS max_violation FROM nfc JOIN bu USING (ts, node)", use="nfc bu", rd="coherence_error max_violation")(
    lambda s, r: R.coherence(node_fc(s, r), H.summation_matrix(E(s, r))))
query("h09_floor_zero", "SELECT ts, node, greatest(yhat - 5000, 0) AS yhat FROM nfc", use="nfc", rd="yhat", digits=4)(
    lambda s, r: R.floor_zero(node_fc(s, r).withColumn("yhat", F.col("yhat") - 5000)))
define("res", "nfc nact", "SELECT ts, node, y - yhat AS e FROM nfc JOIN nact USING (ts, node)")
RES = lambda s, r: R.residuals(*forecasts_and_actuals(s, r))
query("h10_residual_cov", "SELECT a.node AS node_i, b.node AS node_j, covar_samp(a.e, b.e) AS c FROM res a JOIN res b USING (ts) GROUP BY 1, 2", use="res", rd="c", digits=3)(
    lambda s, r: R.cov_frame(RES(s, r)))
query("h10_diagonal_cov", "SELECT a.node AS node_i, b.node AS node_j, CASE WHEN a.node = b.node THEN covar_samp(a.e, b.e) ELSE 0 END AS c FROM res a JOIN res b USING (ts) GROUP BY 1, 2", use="res", rd="c", digits=3)(
    lambda s, r: R.cov_frame(RES(s, r), "diagonal"))
query("h11_ledoit_wolf")(lambda s, r: R.cov_frame(RES(s, r), "ledoit_wolf"))
query("h12_factor_cov")(lambda s, r: R.cov_frame(RES(s, r), "factor"))


@query("h13_shrink_cov")
def h13(s, r):
    res = stable(RES(s, r))
    rows = [(t, how, R.shrink_cov(res, t, how)[2]) for t in ("identity", "diagonal", "constant_correlation", "factor") for how in ("formula", "holdout")]
    return s.createDataFrame(rows, "target string, method string, intensity double")


OLS = """WITH lf AS (SELECT f.ts, f.node, r_name AS region, f.yhat AS m, {vl} AS v FROM nfc f JOIN nation ON n_name = f.node JOIN region ON r_regionkey = n_regionkey {jl}),
 ra AS (SELECT ts, region, sum(m) AS mm, sum(v) AS vv FROM lf GROUP BY 1, 2),
 rg AS (SELECT ra.*, (f.yhat / {vr} + mm / vv) / (1 / {vr} + 1 / vv) AS m, 1 / (1 / {vr} + 1 / vv) AS v FROM ra JOIN nfc f ON f.ts = ra.ts AND f.node = ra.region {jr}),
 ta AS (SELECT ts, sum(m) AS mm, sum(v) AS vv FROM rg GROUP BY 1),
 tt AS (SELECT ta.*, (f.yhat / {vt} + mm / vv) / (1 / {vt} + 1 / vv) AS fin FROM ta JOIN nfc f ON f.ts = ta.ts AND f.node = 'TOTAL' {jt}),
 rf AS (SELECT rg.ts, rg.region, rg.mm, rg.vv, rg.m + rg.v / tt.vv * (tt.fin - tt.mm) AS fin FROM rg JOIN tt USING (ts))
 SELECT ts, 'TOTAL' AS node, fin AS yhat FROM tt UNION ALL SELECT ts, region, fin FROM rf UNION ALL SELECT lf.ts, lf.node, lf.m + lf.v / rf.vv * (rf.fin - rf.mm) FROM lf JOIN rf USING (ts, region)"""
OLS1 = OLS.format(vl="1.0::DOUBLE", vr="1.0::DOUBLE", vt="1.0::DOUBLE", jl="", jr="", jt="")
BOTH = "(yhat / var + km / kv) / (1 / var + 1 / kv)"
TREE = f"""WITH x AS (SELECT f.ts, f.node, f.yhat, coalesce(w.var, 1.0)::DOUBLE AS var FROM nfa f LEFT JOIN {{w}} w ON w.node = f.node),
 lf AS (SELECT ts, node, r_name AS region, yhat AS m, CASE WHEN yhat IS NOT NULL THEN var END AS v FROM x JOIN nation ON n_name = node JOIN region ON r_regionkey = n_regionkey),
 ra AS (SELECT ts, region, sum(m) AS km, sum(v) AS kv, count(*) FILTER (v IS NULL) AS op FROM lf GROUP BY 1, 2),
 rg AS (SELECT ra.*, CASE WHEN op = 0 AND yhat IS NOT NULL THEN {BOTH} WHEN yhat IS NOT NULL THEN yhat WHEN op = 0 THEN km END AS m,
   CASE WHEN op = 0 AND yhat IS NOT NULL THEN 1 / (1 / var + 1 / kv) WHEN yhat IS NOT NULL THEN var WHEN op = 0 THEN kv END AS v
   FROM ra JOIN x ON x.ts = ra.ts AND x.node = ra.region),
 ta AS (SELECT ts, sum(m) AS km, sum(v) AS kv, count(*) FILTER (v IS NULL) AS op FROM rg GROUP BY 1),
 tt AS (SELECT ta.*, CASE WHEN op = 0 AND yhat IS NOT NULL THEN {BOTH} WHEN yhat IS NOT NULL THEN yhat WHEN op = 0 THEN km END AS fin
   FROM ta JOIN x ON x.ts = ta.ts AND x.node = 'TOTAL'),
 rf AS (SELECT rg.ts, rg.region, rg.km, rg.kv, rg.op, CASE WHEN rg.v IS NOT NULL THEN rg.m + CASE WHEN tt.op = 0 AND tt.kv > 0 THEN rg.v / tt.kv * (tt.fin - tt.km) ELSE 0 END
   WHEN tt.op = 1 THEN tt.fin - coalesce(tt.km, 0) END AS fin FROM rg JOIN tt USING (ts))
 SELECT ts, 'TOTAL' AS node, fin AS yhat FROM tt UNION ALL SELECT ts, region, fin FROM rf
 UNION ALL SELECT lf.ts, lf.node, CASE WHEN lf.v IS NOT NULL THEN lf.m + CASE WHEN rf.op = 0 AND rf.kv > 0 THEN lf.v / rf.kv * (rf.fin - rf.km) ELSE 0 END
   WHEN rf.op = 1 THEN rf.fin - coalesce(rf.km, 0) END FROM lf JOIN rf USING (ts, region)"""
define("nfa", "nall nact nodes", "SELECT ts, node, yhat FROM (SELECT DISTINCT ts FROM nact) CROSS JOIN (SELECT node FROM nodes) LEFT JOIN nall USING (ts, node)")
query("h14_reconcile_ols", TREE.format(w="(SELECT node, 1.0::DOUBLE AS var FROM nodes)"), use="nfa nodes", rd="yhat", digits=4)(lambda s, r: R.reconcile_ols(every_fc(s, r)[0], E(s, r)))
define("nvar", "nfa nact", "SELECT node, greatest(var_samp(y - yhat), 1e-10) AS var FROM nfa JOIN nact USING (ts, node) GROUP BY 1")
def _wls(s, r):
    f, y = every_fc(s, r)
    return R.reconcile_wls(f, E(s, r), R.variance_weights(f, y))


def _with_matrix(s, r, fn):
    f, y = every_fc(s, r)
    return fn(f, H.summation_matrix(E(s, r)), R.residuals(f, y))


query("h15_reconcile_wls", TREE.format(w="nvar"), use="nfa nvar", rd="yhat", digits=4)(_wls)
define("ivar", "nfa", "SELECT node, greatest(pow(avg(0.2 * yhat / (2 * 1.96)), 2), 1e-10) AS var FROM nfa GROUP BY 1")
define("evar", "nfa", "SELECT node, greatest(avg(pow(0.1 * yhat, 2)), 1e-10) AS var FROM nfa GROUP BY 1")
define("cvar", "nfa", "SELECT node, 1 / greatest(avg(CASE WHEN node = 'TOTAL' THEN 0.9 ELSE 0.5 + 0.001 * length(node) END), 1e-6)::DOUBLE AS var FROM nfa GROUP BY 1")
THREE = lambda: F.explode(F.array(*[F.lit(x) for x in (0.9, 1.0, 1.1)]))
WEIGHTS = {  # weights of WLS from interval widths, the spread of an ensemble, and stated confidence
    "interval": ("ivar", lambda f: R.interval_weights(f.withColumns({"lo": F.col("yhat") * 0.9, "hi": F.col("yhat") * 1.1}))),
    "ensemble": ("evar", lambda f: R.ensemble_weights(f.withColumn("__f", THREE()).withColumn("yhat", F.col("yhat") * F.col("__f")))),
    "confidence": ("cvar", lambda f: R.confidence_weights(f.withColumn("confidence", F.when(F.col("node") == "TOTAL", 0.9).otherwise(0.5 + 0.001 * F.length("node"))))),
}


def _wls_by(kind):
    cte, weigh = WEIGHTS[kind]

    def run(s, r):
        f = every_fc(s, r)[0]
        return R.reconcile_wls(f, E(s, r), weigh(f))

    query(f"h15_wls_{kind}", TREE.format(w=cte), use=f"nfa {cte}", rd="yhat", digits=4)(run)


for _kind in WEIGHTS:
    _wls_by(_kind)
query("h16_reconcile_mint")(lambda s, r: _with_matrix(s, r, R.reconcile_mint))
query("h17_reconcile_shrink")(lambda s, r: _with_matrix(s, r, R.reconcile_shrink))
query("h16_reconcile_factors")(lambda s, r: (lambda f, y: R.reconcile_factors(f, E(s, r), R.residuals(f, y)))(*every_fc(s, r)))


def _incomplete(name, fn):
    """Every node of every time stamp, those without a forecast included; tests hold it against numpy."""

    def run(s, r):
        f, y = forecasts_and_actuals(s, r, whole=False)
        return f.select("ts", "node").join(fn(s, r, f, y), ["ts", "node"], "left")

    query(name, digits=4)(run)


_incomplete("h14_ols_incomplete", lambda s, r, f, y: R.reconcile_ols(f, E(s, r)))
_incomplete("h15_wls_incomplete", lambda s, r, f, y: R.reconcile_wls(f, E(s, r), R.variance_weights(f, y)))
_incomplete("h16_mint_incomplete", lambda s, r, f, y: R.reconcile_mint(f, H.summation_matrix(E(s, r)), R.residuals(f, y)))
_incomplete("h17_shrink_incomplete", lambda s, r, f, y: R.reconcile_shrink(f, H.summation_matrix(E(s, r)), R.residuals(f, y)))
PROP = """SELECT f.ts, f.node, CASE WHEN f.node IN (SELECT r_name FROM region) AND s.s > 0 AND t.yhat IS NOT NULL THEN f.yhat * t.yhat / s.s ELSE f.yhat END AS yhat
 FROM nfa f JOIN (SELECT ts, sum(yhat) AS s FROM nfa WHERE node IN (SELECT r_name FROM region) GROUP BY 1) s USING (ts) JOIN (SELECT ts, yhat FROM nfa WHERE node = 'TOTAL') t USING (ts)"""
query("h18_reconcile_proportional", PROP, use="nfa", rd="yhat", digits=4)(lambda s, r: R.reconcile_proportional(every_fc(s, r)[0], E(s, r), "TOTAL"))
query("h19_check_constraints", "SELECT 'agg:' || node AS constraint, max(abs(yhat - expected)) AS max_violation, avg(abs(yhat - expected)) AS mean_violation, max(abs(yhat - expected)) <= 1e-6 AS satisfied FROM ksum GROUP BY node UNION ALL SELECT 'floor', max(greatest(-yhat, 0)), avg(greatest(-yhat, 0)), max(greatest(-yhat, 0)) <= 1e-6 FROM nfc".replace("AS constraint", 'AS "constraint"'), use="ksum nfc", rd="max_violation mean_violation", digits=4)(
    lambda s, r: R.check_constraints(node_fc(s, r), R.constraint_table(E(s, r))))
query("h20_enforce_constraints", "SELECT f.ts, s.node, sum(s.w * greatest(f.yhat - 3000, 0)) AS yhat FROM nfc f JOIN smat s ON s.leaf = f.node GROUP BY 1, 2", use="nfc smat", rd="yhat", digits=4)(
    lambda s, r: R.enforce_constraints(node_fc(s, r).withColumn("yhat", F.col("yhat") - 3000), H.summation_matrix(E(s, r))))

define("energy", "", """SELECT l_shipdate AS ts, role || '_' || l_returnflag AS node, role, round(CASE role WHEN 'generation' THEN g WHEN 'consumption' THEN c ELSE l END, 3) AS y FROM (
 SELECT l_shipdate, l_returnflag, sum(l_extendedprice) / 1000 AS g, sum(l_extendedprice * (1 - l_discount)) / 1000 AS c, sum(l_extendedprice * l_tax) / 1000 AS l FROM lineitem GROUP BY 1, 2), (VALUES ('generation'), ('consumption'), ('losses')) v(role)""")
define("roles", "energy", "SELECT ts, sum(y) FILTER (role = 'generation') AS g, sum(y) FILTER (role = 'consumption') AS c, sum(y) FILTER (role = 'losses') AS l FROM energy GROUP BY 1")


def energy(s, r):
    """generation = list price, consumption = discounted price, losses = tax, per day and return flag."""
    p = F.col("l_extendedprice")
    x = tb.load(s, r, "lineitem").groupBy(F.col("l_shipdate").alias("ts"), "l_returnflag").agg(
        (F.sum(p) / 1000).alias("generation"), (F.sum(p * (1 - F.col("l_discount"))) / 1000).alias("consumption"), (F.sum(p * F.col("l_tax")) / 1000).alias("losses"))
    long = x.unpivot(["ts", "l_returnflag"], ["generation", "consumption", "losses"], "role", "v")
    return long.select("ts", F.concat_ws("_", "role", "l_returnflag").alias("node"), "role", F.round("v", 3).alias("y"))


ROLES = lambda s, r: L.by_role(energy(s, r))
LRD = "generation consumption losses"
ENERGY_FC = lambda s, r: energy(s, r).select("ts", "node", F.col("y").alias("yhat"))
ENERGY_ROLES = lambda s, r: energy(s, r).select("node", "role").distinct()
query("h19_check_energy", """SELECT 'energy' AS "constraint", max(v) AS max_violation, avg(v) AS mean_violation, max(v) <= 1e-6 AS satisfied FROM (
 SELECT ts, abs(sum(CASE role WHEN 'generation' THEN y ELSE -y END)) AS v FROM energy GROUP BY 1)""", use="energy", rd="max_violation mean_violation", digits=4)(
    lambda s, r: R.check_constraints(ENERGY_FC(s, r), R.constraint_table(E(s, r), ENERGY_ROLES(s, r)), floor=None))


@query("h20_enforce_energy", """SELECT e.ts, e.node, CASE WHEN e.role <> 'losses' THEN e.y WHEN n.l > 0 THEN greatest(e.y / n.l * (n.g - n.c), 0) ELSE greatest((n.g - n.c) / n.k, 0) END AS yhat
 FROM energy e JOIN (SELECT ts, sum(y) FILTER (role = 'generation') AS g, sum(y) FILTER (role = 'consumption') AS c, sum(y) FILTER (role = 'losses') AS l, count(*) FILTER (role = 'losses') AS k FROM energy GROUP BY 1) n USING (ts)""", use="energy", rd="yhat", digits=4)
def h20_energy(s, r):
    """Loss nodes are scaled to what generation leaves over consumption; the other nodes are leaves of their own."""
    roles = stable(ENERGY_ROLES(s, r))
    own = roles.where("role <> 'losses'").select("node", F.col("node").alias("leaf"), F.lit(1.0).alias("w"))
    return R.enforce_constraints(stable(ENERGY_FC(s, r)), own, roles)


query("h21_losses_percentage", "SELECT ts, g AS generation, c AS consumption, g * 0.08 AS losses, abs(g - c - g * 0.08) < 1e-6 * greatest(abs(g), 1) AS balanced FROM roles", use="roles", rd=LRD)(lambda s, r: L.losses(energy(s, r)))
query("h21_losses_absolute", "SELECT ts, g AS generation, c AS consumption, greatest(g - c, 0) AS losses, true AS balanced FROM roles", use="roles", rd=LRD)(lambda s, r: L.losses(energy(s, r), "absolute"))
query("h21_losses_historical", "SELECT ts, g AS generation, c AS consumption, g * greatest(least((SELECT avg(x) FROM (SELECT l / g AS x FROM roles ORDER BY ts DESC LIMIT 168)), 0.15), 0.0) AS losses FROM roles", use="roles", rd=LRD)(
    lambda s, r: L.losses(energy(s, r), "historical", history=ROLES(s, r).select("ts", (F.col("losses") / F.col("generation")).alias("share"))).drop("balanced"))
query("h21_losses_adaptive", "SELECT ts, g AS generation, c AS consumption, g * greatest(least(0.08 + (SELECT avg(c) FROM roles) / 10000.0 * 0.001, 0.15), 0.0) AS losses FROM roles", use="roles", rd=LRD)(
    lambda s, r: L.losses(energy(s, r), "adaptive").drop("balanced"))
query("h21_losses_rebalanced", "SELECT ts, g * 0.08 AS losses FROM roles", use="roles", rd="losses")(lambda s, r: L.rebalance(L.losses(energy(s, r), "adaptive")).select("ts", "losses"))
query("h22_distribute_losses", "SELECT e.ts, e.node || '_Losses' AS node, e.y / s.s * r.l AS losses FROM energy e JOIN (SELECT ts, sum(y) AS s FROM energy WHERE role = 'consumption' GROUP BY 1) s USING (ts) JOIN roles r USING (ts) WHERE e.role = 'consumption'", use="energy roles", rd="losses")(
    lambda s, r: L.distribute_losses(ROLES(s, r), energy(s, r).where("role = 'consumption'")))
query("h23_adjust_losses", "SELECT e.ts, e.node, e.role, CASE WHEN e.role = 'losses' THEN CASE WHEN r.l > 0 THEN e.y / r.l ELSE 1.0 / k.k END * r.g * 0.07 ELSE e.y END AS y FROM energy e JOIN roles r USING (ts) JOIN (SELECT ts, count(*) AS k FROM energy WHERE role = 'losses' GROUP BY 1) k USING (ts)", use="energy roles", rd="y")(
    lambda s, r: L.adjust_losses(energy(s, r), 0.07))
query("h24_validate_losses", "SELECT *, share > 0.15 AS above_maximum, share < 0.0 AS below_minimum, max_balance_error > 1 AS balance_warning, negative_losses = 0 AND share <= 0.15 AS valid FROM (SELECT count(*) FILTER (l < 0) AS negative_losses, avg(l) / avg(g) AS share, max(abs(g - c - l)) AS max_balance_error FROM roles)".replace("SELECT *, share >", "SELECT negative_losses, share AS mean_share, max_balance_error, share >"), use="roles", rd="mean_share max_balance_error")(
    lambda s, r: L.validate_losses(ROLES(s, r)))
query("h25_loss_stats", "SELECT avg(p) AS mean_pct, stddev_pop(p) AS std_pct, min(p) AS min_pct, max(p) AS max_pct, corr(c, p) AS load_correlation, 0.0::DOUBLE AS hourly_range, (SELECT max(m) - min(m) FROM (SELECT avg(100 * l / g) AS m FROM roles WHERE g > 0 GROUP BY isodow(ts))) AS weekly_range FROM (SELECT 100 * l / g AS p, c FROM roles WHERE g > 0)", use="roles", rd="mean_pct std_pct min_pct max_pct load_correlation weekly_range")(
    lambda s, r: L.loss_stats(ROLES(s, r)))
query("h26_fit_loss_model", "SELECT regr_slope(l / g, c) * 1e6 AS slope, regr_intercept(l / g, c) AS intercept, count(*) AS n FROM roles", use="roles", rd="slope intercept")(
    lambda s, r: L.fit_loss_model(ROLES(s, r)).withColumn("slope", F.col("slope") * 1e6))

define("rec", "nfc", "SELECT * FROM (" + OLS1 + ")")
define("three", "nfc rec nact", "SELECT ts, node, nfc.yhat AS b, rec.yhat AS r, y FROM nfc JOIN rec USING (ts, node) JOIN nact USING (ts, node)")


def trio(s, r):
    """Base, reconciled and actual, written once because several outputs read them."""
    b, y = forecasts_and_actuals(s, r)
    return b, stable(R.reconcile_ols(b, E(s, r))), y


query("h27_recon_quality", "SELECT 100 * avg(abs((y - b) / y)) FILTER (y <> 0) AS mape_base, avg(abs(y - b)) AS mae_base, sqrt(avg((y - b) * (y - b))) AS rmse_base, 100 * avg(abs((y - r) / y)) FILTER (y <> 0) AS mape_reconciled, avg(abs(y - r)) AS mae_reconciled, sqrt(avg((y - r) * (y - r))) AS rmse_reconciled, 0.0::DOUBLE AS max_violation, 0.0::DOUBLE AS mean_violation, 1.0::DOUBLE AS satisfaction, (avg(abs((y - b) / y)) FILTER (y <> 0) - avg(abs((y - r) / y)) FILTER (y <> 0)) / avg(abs((y - b) / y)) FILTER (y <> 0) AS improvement FROM three", use="three",
      rd="mape_base mae_base rmse_base mape_reconciled mae_reconciled rmse_reconciled improvement", digits=5)(
    lambda s, r: R.recon_quality(*trio(s, r), E(s, r)))
query("h28_temporal_stability", "SELECT avg(greatest(c, 0)) AS temporal_stability FROM (SELECT node, corr(db, dr) AS c FROM (SELECT node, b - lag(b) OVER w AS db, r - lag(r) OVER w AS dr FROM three WINDOW w AS (PARTITION BY node ORDER BY ts)) GROUP BY 1)", use="three", rd="temporal_stability")(
    lambda s, r: R.recon_consistency(*trio(s, r)[:2]).select("temporal_stability"))
query("h28_recon_consistency")(lambda s, r: R.recon_consistency(*trio(s, r)[:2]))


def _methods(s, r):
    b, o, a = trio(s, r)
    leaves = tb.load(s, r, "nation").select(F.col("n_name").alias("node"))
    return {"bottom_up": R.bottom_up(b.join(leaves, "node", "left_semi"), H.summation_matrix(E(s, r))), "ols": o}, a


query("h29_compare_recon")(lambda s, r: R.compare_recon(*_methods(s, r))[0])
query("h29_recon_pair_tests")(lambda s, r: R.compare_recon(*_methods(s, r))[1])


@query("h30_select_recon")
def h30(s, r):
    m, a = _methods(s, r)
    sel = R.select_recon({k: (lambda d=d: d) for k, d in m.items()}, a, H.summation_matrix(E(s, r)))
    return sel.select("method", "accuracy", "coherence")


@query("h31_recon_degradation", """SELECT node, slope, r2, n FROM (SELECT node, regr_slope(v, i) AS slope, regr_r2(v, i) AS r2, count(*) AS n FROM (
 SELECT *, row_number() OVER (PARTITION BY node ORDER BY ts)::DOUBLE AS i, count(*) OVER (PARTITION BY node) AS cnt FROM (SELECT node, ts, abs(y - b) - abs(y - r) AS v FROM three)) WHERE i > cnt - 10 GROUP BY 1)""", use="three", rd="slope r2", digits=4)
def h31(s, r):
    b, o, a = trio(s, r)
    x = R._three(b, o, a).withColumn("improvement", F.abs(F.col("y") - F.col("b")) - F.abs(F.col("y") - F.col("r")))
    return R.recon_degradation(x, ["node"]).select("node", "slope", "r2", "n")


query("h32_recon_impact", "SELECT node, 100 * avg(abs((y - b) / y)) FILTER (y <> 0) AS mape_before, 100 * avg(abs((y - r) / y)) FILTER (y <> 0) AS mape_after, 100 * avg(abs((y - r) / y)) FILTER (y <> 0) - 100 * avg(abs((y - b) / y)) FILTER (y <> 0) AS mape_change FROM three GROUP BY 1", use="three", rd="mape_before mape_after mape_change", digits=4)(
    lambda s, r: R.recon_impact(*trio(s, r)))
query("h32_national_check", "SELECT 0.0::DOUBLE AS max_relative_gap, 0::BIGINT AS violations, true AS ok FROM three LIMIT 1", use="three")(
    lambda s, r: R.national_check(trio(s, r)[1], E(s, r), "TOTAL"))
query("h33_compare_ols_mint")(lambda s, r: R.compare_ols_mint(*forecasts_and_actuals(s, r), E(s, r), stable(H.summation_matrix(E(s, r)))))
query("h34_recon_tests", "SELECT count(*) AS n, avg(d) AS mean_diff, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS t FROM (SELECT node, avg(abs(y - b)) - avg(abs(y - r)) AS d FROM three GROUP BY 1)", use="three", rd="mean_diff t", digits=4)(
    lambda s, r: R.recon_tests(*trio(s, r)).select("n", "mean_diff", "t"))

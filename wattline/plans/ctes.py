"""Shared SQL fragments of the oracle queries (DuckDB dialect)."""

from __future__ import annotations

CTES: dict[str, tuple[str, str]] = {}  # name -> (names it needs, text)


def define(name: str, needs: str, text: str) -> None:
    CTES[name] = (needs, text)


def with_ctes(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0].split():
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


define("series", "", """
SELECT event_type AS area, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, round(sum(value), 2) AS load
FROM events GROUP BY 1, 2""")
define("grid", "series", """
SELECT g.area, g.ts, s.load FROM (
  SELECT area, unnest(generate_series(min(ts), max(ts), INTERVAL 30 MINUTE)) AS ts FROM series GROUP BY area) g
LEFT JOIN series s ON s.area = g.area AND s.ts = g.ts""")
define("filled", "grid", """
SELECT area, ts, last_value(load IGNORE NULLS) OVER (PARTITION BY area ORDER BY ts) AS load FROM grid""")
define("daily", "", """
SELECT n_name AS area, o_orderdate AS ts, round(sum(o_totalprice) / 1000, 3) AS load
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2""")
define("dgrid", "daily", """
SELECT g.area, g.ts, s.load FROM (
  SELECT area, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM daily GROUP BY area) g
LEFT JOIN daily s ON s.area = g.area AND s.ts = g.ts""")
define("dfilled", "dgrid", """
SELECT area, ts, last_value(load IGNORE NULLS) OVER (PARTITION BY area ORDER BY ts) AS load FROM dgrid""")
define("exog", "", """
SELECT l_shipdate AS ts, round(avg(l_quantity), 4) AS temperature FROM lineitem GROUP BY 1""")
define("horizons", "", "SELECT unnest([1, 2, 3])::INTEGER AS horizon")


def _forecasts(src: str, season: int) -> str:
    parts = []
    for h in (1, 2, 3):
        last = f"lag(load, {h}) OVER w"
        past = f"OVER (PARTITION BY area ORDER BY ts ROWS BETWEEN {h + 5} PRECEDING AND {h} PRECEDING)"
        exprs = {
            "naive": last,
            "seasonal": f"lag(load, {season}) OVER w",
            "ma": f"CASE WHEN count(load) {past} = 6 THEN round(avg(load) {past}, 4) END",
            "drift": f"round({last} + {h} * ({last} - lag(load, {h + 6}) OVER w) / 6, 4)",
        }
        for m, e in exprs.items():
            parts.append(
                f"SELECT area, ts, '{m}' AS model, {h} AS horizon, {e} AS yhat, load AS y "
                f"FROM {src} WINDOW w AS (PARTITION BY area ORDER BY ts)"
            )
    return "\nUNION ALL\n".join(parts)


define("fcrows", "filled", _forecasts("filled", 48))
define("scored", "fcrows", "SELECT * FROM fcrows WHERE yhat IS NOT NULL AND y IS NOT NULL")
define("dfcrows", "dfilled", _forecasts("dfilled", 7))
define("dscored", "dfcrows", "SELECT * FROM dfcrows WHERE yhat IS NOT NULL AND y IS NOT NULL")
define("edges", "", """
SELECT 'TOTAL' AS parent, r_name AS child, 1.0::DOUBLE AS weight FROM region
UNION ALL SELECT r_name, n_name, 1.0::DOUBLE FROM nation JOIN region ON r_regionkey = n_regionkey""")

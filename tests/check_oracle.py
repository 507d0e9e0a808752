"""Compare registered queries with their SQL on DuckDB.

usage: python tests/check_oracle.py [--sf 0.01] [prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    s = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").appName("wattline")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true").config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    return s


def duck(root: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return c


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else repr(v + 0.0))
    if isinstance(v, (list, tuple)):
        return ("l", tuple(norm(x) for x in v))
    if type(v).__name__ == "Decimal":
        return ("D", str(v))
    return (type(v).__name__, str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, root) -> tuple[str, int]:
    df = fn(spark, root)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return ("rows-only" if got else "EMPTY"), len(got)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}", len(got)
    if len(got) != len(want):
        return f"ROWS {len(got)} vs {len(want)}", len(got)
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    if bad:
        a, b = bad[0]
        names = sorted(cols)
        diff = [(n, x, y) for n, x, y in zip(names, a, b, strict=True) if x != y]
        return f"VALUES {len(bad)} differ; first: {diff} in {a}", len(got)
    return ("ok" if got else "EMPTY"), len(got)


def main(argv: list[str]) -> int:
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()

    root = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(root)
    failed = 0
    for name, fn in queries.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        t0 = time.time()
        try:
            status, n = compare(spark, con, fn, oracles.get(name), root)
        except Exception as e:  # noqa: BLE001
            status, n = f"ERROR {type(e).__name__}: {str(e)[:1500]}", 0
        good = status in ("ok", "rows-only")
        failed += not good
        print(f"{'  ' if good else '!!'} {name:34s} {time.time() - t0:6.2f}s {n:8d} {status[:1600]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

"""Run registered queries on Spark and their SQL on DuckDB and compare rows."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from postmill.queries import load, registry
from postmill.sources.bindings import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple((type(plain(r[i])).__name__, plain(r[i])) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir: str, name: str) -> str:
    df = registry.SPARK[name](spark, sf_dir)
    left_cols, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.SQL:
        return f"rows-only ({len(left)})"
    res = con.execute(registry.SQL[name])
    right_cols, right = rows_of([d[0] for d in res.description], res.fetchall())
    if left_cols != right_cols:
        return f"COLUMNS {left_cols} != {right_cols}"
    if len(left) != len(right):
        return f"ROWS {len(left)} != {len(right)}; {left[:2]} / {right[:2]}"
    for a, b in zip(left, right):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(left_cols, a, b) if x != y]
            return f"VALUES {diff[:4]} in {[x[1] for x in a][:8]}"
    return f"ok ({len(left)})" if left else "EMPTY"


if __name__ == "__main__":
    from postmill.session import local_session

    load()
    sf = os.environ.get("COMPARE_SF_DIR", "/root/testdata/sf0.01")
    asked = sys.argv[1:]
    wanted = [n for n in registry.SPARK if not asked or n in asked or registry.MODULE_OF[n] in asked]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for n in wanted:
        start = time.time()
        try:
            verdict = compare(spark, con, sf, n)
        except Exception as e:  # noqa: BLE001
            verdict = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{n:40s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print("bad:", bad, "of", len(wanted))

"""Compares every query with its SQL on the same tables.

``python tests/oracle.py [--sf 0.01] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

spark_seconds = 0.0  # of the last comparison
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda j: columns[j])
    return sorted((tuple(repr(r[j]) for j in order) for r in rows))


def compare(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    mine_cols = df.columns
    begin = time.time()
    mine = _rows(mine_cols, df.collect())
    global spark_seconds
    spark_seconds = time.time() - begin
    cur = con.execute(sql)
    other_cols = [c[0] for c in cur.description]
    other = _rows(other_cols, cur.fetchall())
    if sorted(mine_cols) != sorted(other_cols):
        return f"columns {sorted(set(mine_cols) ^ set(other_cols))}"
    if len(mine) != len(other):
        return f"rows {len(mine)} vs {len(other)}"
    bad = [(a, b) for a, b in zip(mine, other) if a != b]
    if bad:
        names = sorted(mine_cols)
        a, b = bad[0]
        diff = {n: (x, y) for n, x, y in zip(names, a, b) if x != y}
        return f"{len(bad)} of {len(mine)} rows differ, first {diff} in {dict(zip(names, a))}"
    return ""


def main() -> int:
    from shiftcast.plans.registry import all_queries, all_sql
    from shiftcast.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--module")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    con = connect(sf_dir)
    if args.module:
        from importlib import import_module

        catalog = import_module(f"shiftcast.plans.{args.module}").catalog
        queries, sqls = catalog.queries, catalog.sql
    else:
        queries, sqls = all_queries(), all_sql()
    failures = 0
    for name, fn in queries.items():
        if args.names and name not in args.names:
            continue
        begin = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in sqls:
                problem = compare(df, con, sqls[name])
                kind = "sql"
            else:
                problem, kind = ("" if df.count() else "no rows"), "rows"
        except Exception as e:  # noqa: BLE001 - reported per query
            problem, kind = f"{type(e).__name__}: {str(e)[:1200]}", "error"
        failures += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {kind:5} {spark_seconds:5.2f}s of {time.time() - begin:5.2f}s {name} {problem}", flush=True)
    print(f"{failures} failed")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())

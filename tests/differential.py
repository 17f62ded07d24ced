"""Run catalog queries on Spark and their SQL twins on DuckDB, and compare rows.

Usage: python tests/differential.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6f}"
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, sf_dir: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    left, right = rows_of(df.columns, df.collect()), rows_of(names, cur.fetchall())
    if left == right:
        return None
    a, b = set(left), set(right)
    return f"rows {len(left)} vs {len(right)}; cols {sorted(names)}; spark only {sorted(a - b)[:3]}; sql only {sorted(b - a)[:3]}"


def main() -> int:
    from ledgerloom.catalog import all_oracles, all_queries
    from ledgerloom.plans.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    queries, oracles = all_queries(), all_oracles()
    names = args[1:] or list(queries)
    spark, con = local_session(int(os.environ.get("CORES", "8"))), connect(sf_dir)
    bad = 0
    for name in names:
        t = time.time()
        try:
            if name in oracles:
                verdict = compare(spark, con, queries[name], oracles[name], sf_dir) or "ok"
            else:
                verdict = f"rows-only {queries[name](spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            verdict = f"ERROR {type(e).__name__}: {str(e)[:700]}"
        bad += verdict.startswith(("ERROR", "rows ", "columns"))
        print(f"{name:28s} {time.time() - t:6.1f}s  {verdict}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

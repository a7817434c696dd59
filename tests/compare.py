"""Runs every query with SQL on both engines and compares rows: python tests/compare.py [SF_DIR] [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for p in sorted(Path(d).glob("*.parquet")):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, d: str, query, sql: str) -> str:
    df = query(spark, d)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} {sorted(rel.columns)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"rows {len(got)} {len(want)}; only Spark {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"
    return ""


def main(d: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from tallyloom.session import local_session

    spark, con = local_session("compare", "8"), connect(d)
    queries, oracles, bad = entry.queries(), entry.oracle_sql(), 0
    for n in names or oracles:
        t = time.time()
        why = compare(spark, con, d, queries[n], oracles[n])
        bad += bool(why)
        print(f"{n}: {'ok' if not why else why[:600]} ({time.time() - t:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))

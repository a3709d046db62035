"""Compare named queries with their SQL twins on DuckDB.

Run as a script for a table of all queries: ``python -m tests.oracle [sf] [name ...]``.
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

import __spark_entry__ as entry
from sensorloom.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return repr(v)


def compare(spark, con, name: str, sf_dir: str) -> str:
    """Empty when the query and its twin agree, else what differs."""
    df = entry.queries()[name](spark, sf_dir)
    rows = [tuple(x) for x in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if rows else "no rows"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    got_order = [df.columns.index(c) for c in sorted(df.columns)]
    want_order = [want_cols.index(c) for c in sorted(want_cols)]
    a = sorted(tuple(_cell(x[i]) for i in got_order) for x in rows)
    b = sorted(tuple(_cell(x[i]) for i in want_order) for x in want)
    if not rows:
        return "no rows"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"rows {len(a)} vs {len(b)}; {sorted(df.columns)}; first differences {bad[:2]}"
    return ""


def main(argv: list[str]) -> None:
    sf = argv[0] if argv else "0.01"
    spark = local_session()
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    names = argv[1:] or list(entry.queries())
    bad = 0
    for name in names:
        t = time.time()
        try:
            diff = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        kind = "sql" if name in entry.oracle_sql() else "rows"
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok':4} {kind:4} {time.time() - t:6.1f}s {name} {diff}", flush=True)
    print(f"{len(names)} queries, {bad} failed")


if __name__ == "__main__":
    main(sys.argv[1:])

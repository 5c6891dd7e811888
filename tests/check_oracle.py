"""Compare registered queries with their SQL in DuckDB.  Usage: python tests/check_oracle.py [sf] [name ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple(str(x) for x in t))


def compare(spark, con, name, run, sql, sf_dir):
    """Returns (problem or None, rows, seconds)."""
    start = time.time()
    df = run(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    took = time.time() - start
    if sql is None:
        return None, len(got), took
    res = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got), took
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got), took
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. {got_cols}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}", len(got), took
    if not got:
        return "no rows", 0, took
    return None, len(got), took


if __name__ == "__main__":
    import __spark_entry__ as entry
    from panelcast.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("sf") else "sf0.01"
    names = [a for a in args if not a.startswith("sf")]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/{sf}"
    con = connection(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, run in qs.items():
        if names and not any(n in name for n in names):
            continue
        try:
            problem, n, took = compare(spark, con, name, run, sqls.get(name), sf_dir)
        except Exception as err:  # report and go on
            problem, n, took = f"{type(err).__name__}: {str(err)[:700]}", 0, 0.0
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={n} {took:.2f}s {'' if name in sqls else '(no sql)'} {problem or ''}", flush=True)
    print("failed:", failed)

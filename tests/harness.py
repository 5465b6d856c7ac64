"""Runs registered queries in Spark and their SQL counterparts in DuckDB and compares the rows.

``python -m tests.harness [sf_dir] [name prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb

from microfolio.catalog import ORACLE, QUERIES
from microfolio.sources.fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, sf_dir: str, name: str):
    """Returns (problem or None, number of rows, seconds)."""
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    seconds = time.time() - started
    if name not in ORACLE:
        return (None if got_rows else "no rows"), len(got_rows), seconds
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    want_rows = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}", len(got_rows), seconds
    got, want = normal(df.columns, got_rows), normal(columns, want_rows)
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return f"rows {len(got)} / {len(want)}; {sorted(columns)}; spark only {only_got}; sql only {only_want}", len(got), seconds
    return None, len(got), seconds


def main(argv):
    from microfolio.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.001"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in QUERIES:
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        try:
            problem, n, seconds = compare(spark, con, sf_dir, name)
        except Exception as e:  # report and go on with the next query
            problem, n, seconds = f"{type(e).__name__}: {str(e)[:900]}", -1, 0.0
        bad += problem is not None
        print(f"{'FAIL' if problem else ('ok  ' if name in ORACLE else 'rows')} {name} rows={n} {seconds:.2f}s {problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])

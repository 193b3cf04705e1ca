"""Run registered queries against DuckDB on the same parquet files: python tests/compare.py [sf] [name prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def database(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf{sf}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, "nan" if isinstance(value, float) and math.isnan(value) else float(value))
    if hasattr(value, "as_tuple"):
        return (2, float(value))
    return (3, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf: str) -> str:
    """Empty when both agree, else what differs."""
    df = query(spark, f"{DATA}/sf{sf}")
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if df.columns else "no columns"
    stop = threading.Timer(60, con.interrupt)
    stop.start()
    try:
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        theirs = rows_of(columns, result.fetchall())
    finally:
        stop.cancel()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    return "" if not bad else f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}"


def main() -> None:
    from annograph.catalog import ORACLES, QUERIES
    from annograph.plans.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = [n for n in QUERIES if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]
    spark = build_session(master="local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in ORACLES else '(rows only)'} {problem}", flush=True)
    print(f"{len(names) - failed}/{len(names)} agree", flush=True)


if __name__ == "__main__":
    main()

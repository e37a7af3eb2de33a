"""Runs registered queries and their check SQL side by side.

``python tests/oracle_check.py [sf_dir] [query ...]``
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
import traceback
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, Decimal)):
        return f"{float(value) + 0.0:.9g}"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return str(value)


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, run, sql: str | None, sf_dir: str) -> str:
    """Empty text when both sides agree."""
    df = run(spark, sf_dir)
    got = normal(df.columns, df.collect())
    if sql is None:
        return "" if got else "no rows"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = normal(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{sum(x != y for x, y in zip(got, want))} rows differ, first {str(a)[:400]} against {str(b)[:400]}"
    return ""


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from palaver.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        started = time.time()
        try:
            problem = compare(spark, con, run, sql.get(name), sf_dir)
        except Exception:
            problem = traceback.format_exc()[-1500:]
        failed += bool(problem)
        mark = "ok  " if not problem else "FAIL"
        print(f"{mark} {name} {time.time() - started:.1f}s {'' if name in sql else '(rows only)'} {problem}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

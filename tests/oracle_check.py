"""Run registered queries on Spark and their oracles on DuckDB and compare the rows.

    python tests/oracle_check.py [--sf 0.01] [prefix ...]
"""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def kind(value) -> str:
    return "null" if value is None else type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((kind(v), str(v)) for v in r))


def compare(spark_df, con, sql) -> str | None:
    """None when the results agree, else a short description of the difference."""
    left_cols, left = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    right_cols, right = rows_of(names, cursor.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} vs {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}; first {left[:2]} vs {right[:2]}"
    for a, b in zip(left, right):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(left_cols, a, b) if x != y]
            return f"differs: {bad[:6]}"
        for c, x, y in zip(left_cols, a, b):
            if kind(x) != kind(y):
                return f"type of {c}: {kind(x)} vs {kind(y)}"
    return None


def main(argv: list[str]) -> int:
    from gradewell.plans.registry import load_catalog
    from gradewell.session import build_session

    scale = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        scale = argv[at + 1]
        del argv[at:at + 2]
    folder = f"/root/testdata/sf{scale}"
    spark = build_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.sql.debug.maxToStringFields": "200"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failures = 0
    for name, query in load_catalog().queries.items():
        if argv and not any(name.startswith(prefix) for prefix in argv):
            continue
        start = time.time()
        try:
            if query.sql:
                problem = compare(query(spark, folder), con, query.sql)
                size = ""
            else:
                result = query(spark, folder)
                size = f" rows={len(result.collect())}"
                problem = None
        except Exception as error:  # report and go on with the other queries
            problem, size = f"{type(error).__name__}: {str(error)[:1500]}", ""
        failures += problem is not None
        label = "FAIL" if problem else ("ok  " if query.sql else "rows")
        print(f"{label} {name} {time.time() - start:.2f}s{size} {problem or ''}", flush=True)
    print(f"{failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Run registered queries and their SQL twins side by side: python -m tests.oracle [prefix ...]

The single word "sql" picks every query that has a twin.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")


def duck(folder: str = FOLDER) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or value is pd.NaT:
        return "null"
    if isinstance(value, bool):
        return f"b:{value}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, float):
        return "nan" if value != value else f"f:{value + 0.0!r}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(_cell(v) for v in value) + "]"
    return str(value)


def rows_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str = FOLDER) -> str | None:
    """None when both sides agree, else a description of the first difference."""
    df = entry.queries()[name](spark, folder)
    got_cols, got = rows_of(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got else "no rows"
    result = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}; first {got[:1]} vs {want[:1]}"
    if not got:
        return "no rows on either side"
    for a, b in zip(got, want):
        if a != b:
            diff = [(c, x, y) for c, x, y in zip(got_cols, a, b) if x != y]
            n = sum(x != y for x, y in zip(got, want))
            return f"{n} rows differ, first: {diff[:4]} of {a}"
    return None


def main(patterns: list[str]) -> int:
    from regimecast.session import build_session

    spark = build_session("oracle", cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck()
    bad = 0
    for name in entry.queries():
        if patterns == ["sql"]:
            if name not in entry.oracle_sql():
                continue
        elif patterns and not any(name.startswith(p) for p in patterns):
            continue
        began = time.time()
        try:
            problem = compare(spark, con, name)
        except Exception as e:  # noqa: BLE001 - report every query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - began:.2f}s {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

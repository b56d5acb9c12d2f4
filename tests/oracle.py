"""Run workloads on Spark and their SQL on DuckDB and compare the rows.

    python -m tests.oracle [sf_dir] [name ...]
"""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty text if both sides agree, else what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if len(mine) != len(theirs):
        extra = [r for r in mine if r not in set(theirs)][:2]
        lost = [r for r in theirs if r not in set(mine)][:2]
        return f"rows {len(mine)} / {len(theirs)}; extra {extra}; lost {lost}"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"values {a} / {b}"
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"types {a} / {b}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    from tests.conftest import make_session

    from tradeloom.plans.details import ORACLES, WORKLOADS

    spark, con, failed = make_session(), connect(sf_dir), 0
    for name, query in WORKLOADS.items():
        if names and name not in names:
            continue
        begin = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, query, ORACLES[name], sf_dir)
            else:
                problem = "" if query(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - begin:.1f}s {problem}", flush=True)
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:] or ["/root/testdata/sf0.01"]
    sys.exit(min(1, main(arguments[0], arguments[1:])))

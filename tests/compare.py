"""Spark results against DuckDB: rows as sorted texts of their values, columns by name."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(f"{v:.15g}")
    if isinstance(v, datetime.datetime | datetime.date):
        return str(v)
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in sorted(v.items(), key=str)}
    if isinstance(v, list | tuple) or hasattr(v, "tolist"):
        return [plain(x) for x in v]
    return v


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(sf_dir):
        at = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{at}'")
    return con


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def differences(df, sql: str, con) -> tuple[int, int, list[str]]:
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns), (sorted(df.columns), sorted(names))
    want = rows_of(names, cur.fetchall())
    diff = []
    if got != want:
        a, b = set(got), set(want)
        diff = [f"spark {x[:400]}" for x in sorted(a - b)[:3]] + [f"sql   {x[:400]}" for x in sorted(b - a)[:3]] or ["multiplicity differs"]
    return len(got), len(want), diff

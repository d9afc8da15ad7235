"""Comparing a query's rows with DuckDB's for its SQL: columns by name, rows as a bag, doubles rounded."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _value(v):
    return round(v, 6) if isinstance(v, float) else v


def bag(rows: list[dict]) -> Counter:
    return Counter(tuple(_value(r[k]) for k in sorted(r)) for r in rows)


def differences(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows; else what differs."""
    df = query(spark, sf_dir)
    mine = bag([r.asDict() for r in df.collect()])
    res = connect(sf_dir).sql(sql)
    theirs = bag([dict(zip(res.columns, r, strict=True)) for r in res.fetchall()])
    if sorted(df.columns) != sorted(res.columns):
        return f"columns {sorted(df.columns)} and {sorted(res.columns)}"
    one, two = mine - theirs, theirs - mine
    return "" if not one and not two else f"{sum(one.values())} rows only here, {sum(two.values())} only there, of {sum(theirs.values())}: {list(one)[:2]} {list(two)[:2]}"

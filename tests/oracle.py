"""Compares a query's rows with those of its SQL on the same files."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        x = float(v)
        if math.isnan(x):
            return "nan"
        return round(x, 5) + 0.0
    return str(v)


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(_plain(r[k]) for k in order) for r in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if columns and rows agree."""
    want = con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    have, need = bag(df.columns, df.collect()), bag(want.columns, want.fetchall())
    if have == need:
        return ""
    return (
        f"{have.total()} and {need.total()} rows; only here {list((have - need).items())[:3]}; "
        f"only in SQL {list((need - have).items())[:3]}"
    )

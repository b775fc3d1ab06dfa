"""Compare a Spark query with its SQL in DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


def told(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, str)):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(told(v) for v in r) for r in df.astype(object).values.tolist()), key=str)


def assert_same(spark, data: str, query, sql: str) -> None:
    a, b = query(spark, data).toPandas(), connect(data).sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)

"""Compares a query's rows with those of its DuckDB SQL, as sets with repeats."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet/*.parquet')" if _is_dir(f"{sf_dir}/{t}.parquet") else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _is_dir(path: str) -> bool:
    import os

    return os.path.isdir(path)


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[int, str]:
    """Number of rows, and what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    relation = con.sql(sql)
    want = rows_of(relation.columns, relation.fetchall())
    if sorted(df.columns) != sorted(relation.columns):
        return sum(got.values()), f"columns {df.columns} and {relation.columns}"
    if got != want:
        return sum(got.values()), f"{sum(got.values())} and {sum(want.values())} rows; only Spark {list((got - want).items())[:2]}; only SQL {list((want - got).items())[:2]}"
    return sum(got.values()), ""

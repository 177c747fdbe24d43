"""Holds a query's rows against DuckDB's on the same files."""

import math
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def assert_same(df, sql: str, sf_dir: str) -> None:
    relation = connect(sf_dir).sql(sql)
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    order = [relation.columns.index(n) for n in names]
    want = sorted([plain(r[i]) for i in order] for r in relation.fetchall())
    got = sorted([plain(r[n]) for n in names] for r in df.collect())
    assert got == want

"""Spark results against DuckDB's on the same parquet files."""

import math
import os

import duckdb

from lodestar.sources.tables import TABLES

# Spark's type names and DuckDB's.
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def oracle(sf_dir, text):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(text)
    columns = [(d[0], str(d[1])) for d in result.description]
    return columns, result.fetchall()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6g}"
    return str(value)


def assert_same(df, sf_dir, text):
    columns, expected = oracle(sf_dir, text)
    names = sorted(df.columns)
    assert names == sorted(n for n, _ in columns)
    kinds = dict(columns)
    assert {n: TYPES.get(t, t.upper()) for n, t in df.dtypes} == kinds
    at = [[n for n, _ in columns].index(n) for n in names]
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in expected)

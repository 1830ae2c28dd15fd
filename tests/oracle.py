"""Compares a query with its SQL on DuckDB, regardless of row order."""

import math
import os

import duckdb
import numpy as np


def connect(folder):
    c = duckdb.connect()
    for table in sorted(os.listdir(folder)):
        path = f"{folder}/{table}"
        c.sql(f"create view {table.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def cell(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(cell, v)) + "]"
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, np.integer)):
        return str(int(v))
    if isinstance(v, (float, np.floating)):
        return str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else f"{v:.9g}"
    return str(v)


def rows(df):
    return sorted("|".join(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def assert_same(spark, connection, build, sql, folder):
    mine, other = build(spark, folder).toPandas(), connection.sql(sql).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)
    return len(mine)

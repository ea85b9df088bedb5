"""Comparison of a query's rows with its DuckDB oracle."""

from __future__ import annotations

import glob
import math
import os

import duckdb
from pyspark.sql import DataFrame

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) and glob.glob(f"{path}/*.parquet") else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(v):  # noqa: ANN001, ANN202
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    return v


def rows_of_spark(df: DataFrame) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(r[n]) for n in names) for r in (r.asDict(recursive=True) for r in df.collect())), key=repr)


def rows_of_duckdb(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    names = sorted(columns)
    return names, sorted((tuple(_plain(r[columns.index(n)]) for n in names) for r in got.fetchall()), key=repr)

"""Strict, order-free comparison of a Spark result with DuckDB on the same tables."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{path}'")
    return con


def _kind(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value.item() if hasattr(value, "item") else value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(repr(_kind(r[i])) for i in order) for r in rows]
    return sorted(columns), sorted(out)


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    table = con.sql(sql).to_arrow_table()
    return _rows(table.column_names, list(zip(*[c.to_pylist() for c in table.columns]))), table.schema

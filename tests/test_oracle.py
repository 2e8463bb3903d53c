"""Every query with SQL must give the same rows in DuckDB; the others must at least run."""

import os

import pytest

import __spark_entry__ as entry_module
from compare import connect, duck_rows, spark_rows

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = entry_module.oracle_sql()
QUERIES = entry_module.queries()
TYPES = {"int": "int32", "bigint": "int64", "double": "double", "string": "string", "boolean": "bool"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    columns, rows = spark_rows(df)
    (sql_columns, sql_rows), schema = duck_rows(con, SQL[name])
    assert columns == sql_columns
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == {f.name: str(f.type) for f in schema}
    assert rows == sql_rows
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == 42

"""Every registered query against its SQL counterpart on whole tables."""

import pytest
from oracle import duckdb_on, spark_rows, sql_rows

import __spark_entry__ as registry

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return duckdb_on(SF_DIR)


TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


@pytest.mark.parametrize("name", [q.__name__ for q in registry.QUERIES])
def test_query_equals_sql(spark, connection, name):
    df, sql = registry.queries()[name](spark, SF_DIR), registry.oracle_sql()[name]
    relation = connection.sql(sql)
    expected_types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == expected_types
    names, rows = spark_rows(df)
    expected_names, expected = sql_rows(connection, sql)
    assert names == expected_names
    assert len(rows) > 0
    assert rows == expected


def test_entry_runs(spark):
    assert registry.entry(spark).count() > 0

"""Comparing a Spark result with the result of SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb

from seektrail.sources.model import SCHEMAS


def duckdb_on(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in SCHEMAS:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def rows_of(columns, rows):
    """Columns sorted by name and rows sorted, as a multiset that does not depend on order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(row) for row in df.collect()])


def sql_rows(connection, sql):
    result = connection.execute(sql)
    return rows_of([c[0] for c in result.description], result.fetchall())

"""Small inline logs."""

from datetime import datetime, timedelta

from seektrail.sources.model import SEARCH_LOG_SCHEMA

START = datetime(2025, 5, 2)
MICROSECOND = timedelta(microseconds=1)


def at(minutes=0, micros=0):
    return START + timedelta(minutes=minutes, microseconds=micros)


def search(event_id, ts, user=1, results=1, **cond):
    return (event_id, ts, user, "search", results, cond)


def detail(event_id, ts, user=1):
    return (event_id, ts, user, "detail", None, {})


def other(event_id, ts, user=1):
    return (event_id, ts, user, "other", None, {})


def log_of(spark, *rows):
    return spark.createDataFrame(list(rows), SEARCH_LOG_SCHEMA)


def by_event(df, *columns):
    """{event_id: value} or {event_id: (values)} of a result."""
    rows = {row["event_id"]: tuple(row[c] for c in columns) for row in df.collect()}
    return {k: v[0] if len(columns) == 1 else v for k, v in rows.items()}


def multiset(df):
    columns = sorted(df.columns)
    return sorted((repr([row[c] for c in columns]) for row in df.collect()))

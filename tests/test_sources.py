from fixtures import multiset
from pyspark.sql import functions as F

from seektrail.sources.model import SCHEMAS, SEARCH_LOG_SCHEMA
from seektrail.sources.tables import read_table, search_log


def events(spark):
    rows = [
        (1, None, 1, "view", 1.0, '{"k": 69}'),
        (2, None, 1, "error", 1.0, '{"k": 5}'),
        (3, None, 1, "click", 1.0, "{}"),
        (4, None, 1, "signup", 1.0, '{"k": "many"}'),
        (5, None, 1, "purchase", 1.0, "not json"),
        (6, None, 1, None, 1.0, None),
    ]
    return spark.createDataFrame(rows, SCHEMAS["events"])


def test_events_as_search_log(spark):
    log = search_log(events(spark))
    assert log.dtypes == spark.createDataFrame([], SEARCH_LOG_SCHEMA).dtypes
    found = {r["event_id"]: (r["kind"], r["result_count"], r["cond"]) for r in log.collect()}
    unknown = {"area": None, "price": None}
    assert found == {
        1: ("search", 1, {"area": "6", "price": "9"}),
        2: ("search", 0, {"area": "0", "price": "5"}),
        3: ("detail", None, unknown),
        4: ("other", None, unknown),
        5: ("other", None, unknown),
        6: ("other", None, unknown),
    }


def test_kinds_are_the_same_rows_filtered_early(spark):
    table = read_table(spark, "/root/testdata/sf0.001", "events").unionByName(events(spark))
    for kinds in (["search"], ["search", "detail"], ["other"], ["detail", "other"]):
        expected = search_log(table).filter(F.col("kind").isin(kinds))
        assert multiset(search_log(table, kinds)) == multiset(expected)

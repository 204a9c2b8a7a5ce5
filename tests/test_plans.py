"""The plans of the registered queries."""

import re

import pytest

import __spark_entry__ as registry
from seektrail.plans import hot
from seektrail.sources.tables import read_table, search_log

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def plan_of(spark):
    def plan(name):
        df = registry.queries()[name](spark, SF_DIR)
        return df._jdf.queryExecution().executedPlan().toString()

    return plan


@pytest.mark.parametrize("name", [q.__name__ for q in registry.QUERIES])
def test_no_python_and_no_pairs_of_everything(plan_of, name):
    plan = plan_of(name)
    assert "Python" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize(
    ("name", "exchanges"),
    [
        ("re_search", 1),
        ("condition_change", 1),
        ("detail_entry", 1),
        ("detail_attribution", 1),
        ("search_sessions", 1),
        ("transitions", 2),
        ("session_paths", 2),
        ("no_result_recovery", 2),
        ("latest", 1),
        ("snapshot_diff", 1),
        ("table_differences", 1),
        ("quarantine_rejected", 0),
        ("pii_mask", 0),
        ("fingerprint", 1),
    ],
)
def test_shuffles(plan_of, name, exchanges):
    plan = plan_of(name)
    assert len(re.findall(r"\bExchange\b", plan)) == exchanges
    assert len(re.findall(r"\bSort \[", plan)) <= max(exchanges, 1) * 2


@pytest.mark.parametrize(
    ("name", "filters", "columns"),
    [
        ("no_result_rate", "In(event_type, [error,view])", "ts,event_type"),
        ("re_search", "In(event_type, [error,view])", "event_id,ts,user_id,event_type"),
        ("detail_entry", "In(event_type, [click,error,view])", "event_id,ts,user_id,event_type"),
        ("transitions", "", "event_id,ts,user_id,event_type"),
        ("duplicate_keys", "", "l_orderkey,l_linenumber"),
    ],
)
def test_scans_read_only_what_is_needed(plan_of, name, filters, columns):
    plan = plan_of(name)
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan).group(1)
    assert filters in pushed
    read = re.search(r"ReadSchema: struct<(.*?)>", plan).group(1)
    assert ",".join(field.split(":")[0] for field in read.split(",")) == columns


def test_partial_aggregation_before_every_grouping_shuffle(plan_of):
    for name in ("no_result_rate", "duplicate_keys", "table_differences", "column_profile"):
        assert "partial_" in plan_of(name), name


def test_hot_users_of_a_log_are_looked_for_once(spark, monkeypatch):
    monkeypatch.setattr(hot, "_found", {})
    for _ in range(2):
        hot.spread_users(search_log(read_table(spark, SF_DIR, "events")))
    assert len(hot._found) == 1


def test_queries_and_oracles_belong_together():
    assert set(registry.oracle_sql()) >= {q.__name__ for q in registry.QUERIES}
    assert set(registry.oracle_sql()) <= set(registry.queries())

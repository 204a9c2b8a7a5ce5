import pytest
from fixtures import at, log_of, search

from seektrail.operators import quality as q


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, 10, "A-1", at(5)),
        (1, 11, "A-2", at(0)),
        (2, None, "A-3", at(1)),
        (3, -1, "bad", at(2)),
        (None, 99, None, None),
        (None, 5, "A-9", at(9)),
        (4, 3, "A-4", at(0)),
    ]
    return spark.createDataFrame(rows, "k bigint, n int, code string, at timestamp_ntz")


@pytest.fixture(scope="module")
def parents(spark):
    return spark.createDataFrame(
        [(1, at(1)), (2, at(1)), (2, at(0)), (4, None)], "id bigint, at timestamp_ntz"
    )


def test_report(items, parents):
    rules = [
        q.not_null("items", "k"),
        q.in_range("items", "n", 0, 50),
        q.matches("items", "code", "^A-[0-9]$"),
        q.UniqueKey("key", "items", ("k",)),
        q.Reference("parent", "items", ("k",), "parents", ("id",)),
        q.TimeOrder("order", "items", ("k",), "at", "parents", ("id",), "at"),
        q.not_null("parents", "at"),
    ]
    report = q.quality_report({"items": items, "parents": parents}, rules)
    assert {(r["table"], r["rule"]): (r["checked"], r["failed"]) for r in report.collect()} == {
        ("items", "k not null"): (7, 2),
        ("items", "n in range"): (6, 2),
        ("items", "code format"): (6, 1),
        ("items", "key"): (7, 4),
        ("items", "parent"): (5, 1),
        ("items", "order"): (3, 1),
        ("parents", "at not null"): (4, 1),
    }


def test_report_on_empty_tables(items, parents):
    rules = [
        q.not_null("items", "k"),
        q.UniqueKey("key", "items", ("k",)),
        q.Reference("parent", "items", ("k",), "parents", ("id",)),
        q.TimeOrder("order", "items", ("k",), "at", "parents", ("id",), "at"),
    ]
    report = q.quality_report({"items": items.limit(0), "parents": parents}, rules)
    assert [(r["checked"], r["failed"]) for r in report.collect()] == [(0, 0)] * 4


def test_row_rules_share_one_pass(items):
    rules = [q.not_null("items", "k"), q.in_range("items", "n", 0, 50)]
    plan = q.check_rows(items, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_rows_behind_the_counts(items, parents):
    assert {tuple(r) for r in q.duplicate_keys(items, ["k"]).collect()} == {(1, 2), (None, 2)}
    assert [r["k"] for r in q.orphans(items, ["k"], parents, ["id"]).collect()] == [3]
    early = q.too_early(items, ["k"], "at", parents, ["id"], "at").collect()
    assert [(r["code"], r["parent_time"]) for r in early] == [("A-2", at(1))]


def test_quarantine_splits_without_loss(items):
    rules = [q.not_null("items", "k"), q.in_range("items", "n", 0, 50)]
    valid, rejected = q.quarantine(items, rules)
    assert valid.columns == items.columns
    assert valid.count() == 4
    assert sorted(tuple(r["failed_rules"]) for r in rejected.collect()) == [
        ("k not null",),
        ("k not null", "n in range"),
        ("n in range",),
    ]


def test_search_without_count_is_a_quality_failure(spark):
    from pyspark.sql import functions as F

    rule = q.RowRule(
        "searches have a count",
        "log",
        lambda: F.col("kind") == "search",
        lambda: F.col("result_count").isNull(),
    )
    log = log_of(spark, search(1, at(0)), search(2, at(1), results=None))
    assert [tuple(r) for r in q.check_rows(log, [rule]).collect()] == [(rule.name, 2, 1)]

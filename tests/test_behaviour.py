from datetime import timedelta

import pytest
from fixtures import at, by_event, detail, log_of, other, search
from pyspark.sql import functions as F

from seektrail.operators import behaviour

HALF_HOUR = timedelta(minutes=30)


@pytest.fixture(scope="module")
def empty(spark):
    return log_of(spark)


def test_unknown_result_count_is_left_out_of_the_rate(spark):
    log = log_of(
        spark,
        search(1, at(0), results=0),
        search(2, at(1), results=3),
        search(3, at(2), results=None),
        detail(4, at(3)),
    )
    rows = behaviour.no_result_rate(log, ["user_id"]).collect()
    assert [tuple(r) for r in rows] == [(1, 2, 1, 0.5)]


def test_re_search_limit_is_inclusive(spark):
    log = log_of(
        spark,
        search(1, at(0), results=0),
        search(2, at(30)),
        search(3, at(60, 1)),
        search(4, at(61), user=2),
    )
    found = by_event(behaviour.re_search(log, HALF_HOUR), "prev_event_id", "after_no_result")
    assert found == {1: (None, None), 2: (1, True), 3: (None, None), 4: (None, None)}


def test_re_search_looks_past_details_and_breaks_ties_by_event(spark):
    log = log_of(spark, search(2, at(0)), detail(3, at(0)), search(1, at(0)), search(4, at(1)))
    found = by_event(behaviour.re_search(log, HALF_HOUR), "prev_event_id")
    assert found == {1: None, 2: 1, 4: 2}


def test_condition_changes(spark):
    log = log_of(
        spark,
        search(1, at(0), area="a", price="1"),
        search(2, at(1), area="b", price="1"),
        search(3, at(2), area="b"),
        search(4, at(3), area="b", stars="5"),
        search(5, at(4), area="b", stars="5"),
        search(6, at(5), area="b", stars=None),
        search(7, at(6), area="b", stars=None),
        search(8, at(7), area="b"),
        search(9, at(8), area="c", price="2", stars="1"),
    )
    found = by_event(behaviour.condition_change(log, HALF_HOUR), "changed")
    assert found == {
        2: ["area"],
        3: ["price"],
        4: ["stars"],
        5: [],
        6: ["stars"],
        7: [],
        8: ["stars"],
        9: ["area", "price", "stars"],
    }


def test_missing_conditions_count_as_none(spark):
    rows = [(1, at(0), 1, "search", 1, None), search(2, at(1), area="a"), search(3, at(2))]
    found = by_event(behaviour.condition_change(log_of(spark, *rows), HALF_HOUR), "changed")
    assert found == {2: ["area"], 3: ["area"]}


def test_first_detail_per_search(spark):
    log = log_of(
        spark,
        search(1, at(0)),
        detail(2, at(1)),
        detail(3, at(2)),
        search(4, at(3)),
        other(5, at(4)),
        detail(6, at(5)),
        search(7, at(40)),
        detail(8, at(70)),
        search(9, at(100)),
        detail(10, at(130, 1)),
    )
    assert by_event(behaviour.detail_entry(log, HALF_HOUR), "detail_event_id") == {
        1: 2,
        4: 6,
        7: 8,
        9: None,
    }
    assert by_event(behaviour.detail_attribution(log, HALF_HOUR), "search_event_id") == {
        2: 1,
        3: 1,
        6: 4,
        8: 7,
        10: None,
    }


def test_detail_at_the_time_of_the_search(spark):
    log = log_of(spark, detail(1, at(0)), search(2, at(0)), detail(3, at(0)))
    assert by_event(behaviour.detail_entry(log, HALF_HOUR), "detail_event_id") == {2: 3}
    attributed = by_event(behaviour.detail_attribution(log, HALF_HOUR), "search_event_id")
    assert attributed == {1: None, 3: 2}


def test_recovery_outcomes(spark):
    log = log_of(
        spark,
        search(1, at(0), results=0),
        search(2, at(1), results=0),
        other(3, at(2)),
        detail(4, at(3)),
        search(5, at(4), results=0),
        search(6, at(5), results=2),
        search(7, at(6), results=0),
        search(8, at(7), results=None),
        search(9, at(8), results=0),
        search(10, at(8), user=2, results=0),
        search(11, at(39), user=2),
    )
    rows = behaviour.no_result_recovery(log, HALF_HOUR).collect()
    assert {r["outcome"]: r["searches"] for r in rows} == {
        "no_result": 1,
        "detail": 1,
        "results": 1,
        "unknown": 1,
        "abandoned": 2,
    }


def test_top_conditions(spark):
    log = log_of(
        spark,
        search(1, at(0), results=0, area="a", price="1"),
        search(2, at(1), results=0, area="a", price="2"),
        search(3, at(2), results=4, area="a", price="2"),
        search(4, at(3), results=None, area="a"),
    )
    rows = [tuple(r) for r in behaviour.no_result_conditions(log, 2).collect()]
    assert rows == [("area", "a", 3, 2, 2 / 3), ("price", "1", 1, 1, 1.0)]


def test_empty_log_gives_empty_results(empty):
    for result in (
        behaviour.no_result_rate(empty, ["user_id"]),
        behaviour.re_search(empty, HALF_HOUR),
        behaviour.condition_change(empty, HALF_HOUR),
        behaviour.detail_entry(empty, HALF_HOUR),
        behaviour.no_result_recovery(empty, HALF_HOUR),
        behaviour.detail_attribution(empty, HALF_HOUR),
        behaviour.no_result_conditions(empty, 3),
    ):
        assert result.count() == 0


def test_entries_agree_with_attribution_and_recovery(spark):
    from seektrail.sources.tables import read_table, search_log

    log = search_log(read_table(spark, "/root/testdata/sf0.01", "events"))
    within = timedelta(hours=6)
    entries = behaviour.detail_entry(log, within).filter("entered")
    attributed = behaviour.detail_attribution(log, within).select("search_event_id")
    assert entries.count() == attributed.dropna().distinct().count() == 411
    assert attributed.dropna().count() == 435
    assert behaviour.re_search(log, within).filter("is_re_search").count() == 812
    recovery = behaviour.no_result_recovery(log, within).collect()
    outcomes = {r["outcome"]: r["searches"] for r in recovery}
    assert sum(outcomes.values()) == log.filter("result_count = 0").count()
    assert outcomes == {"no_result": 186, "results": 198, "detail": 205, "abandoned": 1425}
    assert outcomes["detail"] == entries.filter(F.col("result_count") == 0).count()

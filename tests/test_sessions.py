from datetime import timedelta

import pytest
from fixtures import at, detail, log_of, other, search

from seektrail.operators import sessions

GAP = timedelta(minutes=30)


def test_events_a_gap_apart_share_a_session(spark):
    log = log_of(
        spark,
        search(1, at(0), results=0),
        search(2, at(30)),
        detail(3, at(60)),
        search(4, at(90, 1)),
        other(5, at(0), user=2),
    )
    rows = sessions.search_sessions(log, GAP).orderBy("user_id", "session_start").collect()
    assert [tuple(r) for r in rows] == [
        (1, at(0), at(60), 3, 2, 1, 1),
        (1, at(90, 1), at(90, 1), 1, 1, 0, 0),
        (2, at(0), at(0), 1, 0, 0, 0),
    ]


def test_transitions_within_users(spark):
    log = log_of(
        spark,
        search(1, at(0), results=0),
        search(2, at(500)),
        detail(3, at(501)),
        search(4, at(502)),
        detail(5, at(503)),
        detail(6, at(0), user=2),
    )
    rows = sessions.transitions(log).collect()
    assert {(r["step"], r["next_step"]): r["pairs"] for r in rows} == {
        ("no_result", "search"): 1,
        ("search", "detail"): 2,
        ("detail", "search"): 1,
    }


def test_paths_are_cut_and_marked(spark):
    log = log_of(
        spark,
        search(1, at(0), results=0),
        search(2, at(1)),
        detail(3, at(2)),
        search(4, at(0), user=2, results=0),
        search(5, at(1), user=2),
    )
    rows = sessions.session_paths(log, GAP, max_len=2).collect()
    assert {(r["path"], r["longer"]): r["sessions"] for r in rows} == {
        ("no_result>search", True): 1,
        ("no_result>search", False): 1,
    }
    whole = sessions.session_paths(log, GAP, max_len=3).collect()
    assert {r["path"] for r in whole} == {"no_result>search>detail", "no_result>search"}


@pytest.mark.parametrize("operator", [sessions.search_sessions, sessions.transitions])
def test_empty_log(spark, operator):
    arguments = (GAP,) if operator is sessions.search_sessions else ()
    assert operator(log_of(spark), *arguments).count() == 0

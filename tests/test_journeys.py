"""Journey patterns against plain Python, with and without slices."""

from collections import Counter
from datetime import timedelta

import numpy as np
import pytest
from fixtures import START, log_of

from seektrail.operators.journeys import journey_patterns, parse, pattern_matches
from seektrail.plans import hot

PATTERNS = {
    "lost": "search no_result+ search detail",
    "gave in": "no_result+ search",
    "once": "detail",
    "twice": "search search+",
    "many": "no_result+ other+ no_result detail+",
}
WITHIN = timedelta(minutes=9)


def at(seconds):
    return START + timedelta(seconds=seconds)


def random_rows(seed, users, events):
    random = np.random.default_rng(seed)
    kinds = [("search", 0), ("search", 0), ("search", 3), ("detail", None), ("other", None), ("search", None)]
    rows = []
    for i in range(events):
        kind, count = kinds[random.integers(len(kinds))]
        user = None if random.random() < 0.05 else int(random.integers(users))
        rows.append((i, at(int(random.integers(events * 40 // users))), user, kind, count, {}))
    return rows


def plain_matches(rows, patterns, within):
    timelines = {}
    for event_id, ts, user, kind, count, _ in rows:
        if user is not None and ts is not None:
            step = "no_result" if kind == "search" and count == 0 else kind
            timelines.setdefault(user, []).append((ts, event_id, step))
    found = Counter()
    for user, events in timelines.items():
        events.sort()
        for name, text in patterns.items():
            steps = parse(text)
            starts = {}  # (end, steps done) to the latest start
            for e, (ts, event_id, step) in enumerate(events):
                for j, (wanted, repeated) in enumerate(steps):
                    if step == wanted:
                        come = [ts] if j == 0 else [starts.get((e - 1, j - 1))]
                        come += [starts.get((e - 1, j))] if repeated else []
                        come = [c for c in come if c is not None]
                        if come:
                            starts[e, j] = max(come)
                start = starts.get((e, len(steps) - 1))
                if start is not None and ts <= start + within:
                    found[name, user, event_id, start, ts] += 1
    return found


def found_matches(df):
    columns = ("pattern", "user_id", "event_id", "started", "ended")
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_are_those_of_plain_python(spark, seed):
    rows = random_rows(seed, 12, 1_500)
    log = log_of(spark, *rows).repartition(5)
    expected = plain_matches(rows, PATTERNS, WITHIN)
    assert set(k[0] for k in expected) == set(PATTERNS)
    assert found_matches(pattern_matches(log, PATTERNS, WITHIN)) == expected


@pytest.mark.parametrize("limit", [7, 60])
def test_slices_of_a_hot_user_change_nothing(spark, limit):
    rows = [r if r[0] % 3 else (*r[:2], 1, *r[3:]) for r in random_rows(3, 8, 400)]
    # A run that goes through whole slices, at one time.
    rows += [(1_000 + k, at(90_000), 1, "search", 0, {}) for k in range(200)]
    rows += [(2_000, at(90_001), 1, "search", 2, {}), (2_001, at(90_002), 1, "detail", None, {})]
    log = log_of(spark, *rows)
    hot.forget()
    spark.conf.set("seektrail.hotRows", str(limit))
    try:
        cut = hot.spread_users(log)
        assert "slice" in cut.columns and cut.select("slice").distinct().count() > 4
        found = found_matches(pattern_matches(cut, PATTERNS, WITHIN))
    finally:
        spark.conf.unset("seektrail.hotRows")
        hot.forget()
    assert found == plain_matches(rows, PATTERNS, WITHIN)


def test_summary_and_edges(spark):
    rows = [
        (1, at(0), 1, "search", 0, {}), (2, at(60), 1, "search", 1, {}), (3, at(0), 2, "search", 0, {}),
        (4, at(540), 2, "search", 1, {}), (5, at(0), 3, "search", 0, {}), (6, at(541), 3, "search", 1, {}),
        (7, at(0), None, "search", 0, {}), (8, at(1), None, "search", 1, {}),
    ]
    summary = journey_patterns(log_of(spark, *rows), {"gave in": "no_result+ search"}, WITHIN).collect()
    assert [tuple(r) for r in summary] == [("gave in", 2, 2, at(60))]
    assert journey_patterns(log_of(spark), PATTERNS, WITHIN).collect() == []
    for wrong in ("", "search look"):
        with pytest.raises(ValueError):
            parse(wrong)


def test_all_patterns_take_one_shuffle(spark):
    log = log_of(spark, *random_rows(1, 5, 50))
    plan = pattern_matches(log, PATTERNS, WITHIN)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort ") == 1

"""Operators against plain Python on random logs with many equal timestamps."""

import random
from collections import Counter
from datetime import timedelta
from itertools import groupby

import pytest
from fixtures import at, log_of

from seektrail.operators import behaviour, sessions

W = timedelta(minutes=30)
FIELDS = ("area", "price")


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for event_id in range(400):
        kind = rng.choice(["search", "search", "detail", "other"])
        cond = {f: rng.choice(["1", "2", None]) for f in FIELDS if rng.random() < 0.7}
        count = rng.choice([0, 0, 2, None]) if kind == "search" else None
        # Multiples of ten minutes give many ties and many distances of exactly W.
        rows.append((event_id, at(10 * rng.randrange(150)), rng.randrange(6), kind, count, cond))
    rng.shuffle(rows)
    return rows


@pytest.fixture(params=[1, 2, 3], scope="module")
def case(request, spark):
    rows = random_rows(request.param)
    ordered = sorted(rows, key=lambda r: (r[2], r[1], r[0]))
    users = [list(group) for _, group in groupby(ordered, key=lambda r: r[2])]
    return log_of(spark, *rows).repartition(4).cache(), users


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_re_search_and_changes(case):
    log, users = case
    marked, changed = {}, {}
    for events in users:
        searches = [e for e in events if e[3] == "search"]
        for before, event in zip([None, *searches], searches, strict=False):
            near = before is not None and event[1] - before[1] <= W
            marked[event[0]] = before[0] if near else None
            if near:
                changed[event[0]] = [
                    f
                    for f in FIELDS
                    if (f in before[5], before[5].get(f)) != (f in event[5], event[5].get(f))
                ]
    found = behaviour.re_search(log, W).select("event_id", "prev_event_id").collect()
    assert dict(map(tuple, found)) == marked
    found = behaviour.condition_change(log, W).select("event_id", "changed").collect()
    assert dict(map(tuple, found)) == changed


def test_entries_recovery_and_attribution(case):
    log, users = case
    entries, attributed, outcomes = {}, {}, Counter()
    for events in users:
        steps = [e for e in events if e[3] != "other"]
        for i, event in enumerate(steps):
            if event[3] == "detail":
                searches = [e for e in steps[:i] if e[3] == "search"]
                near = searches and event[1] - searches[-1][1] <= W
                attributed[event[0]] = searches[-1][0] if near else None
                continue
            after = steps[i + 1] if i + 1 < len(steps) else None
            if after is not None and after[1] - event[1] > W:
                after = None
            entries[event[0]] = after[0] if after and after[3] == "detail" else None
            if event[4] == 0:
                names = {0: "no_result", 2: "results", None: "unknown"}
                is_detail = after is not None and after[3] == "detail"
                outcome = "detail" if is_detail else names[after[4]] if after else "abandoned"
                outcomes[outcome] += 1
    found = behaviour.detail_entry(log, W).select("event_id", "detail_event_id").collect()
    assert dict(map(tuple, found)) == entries
    found = behaviour.detail_attribution(log, W).select("event_id", "search_event_id").collect()
    assert dict(map(tuple, found)) == attributed
    assert dict(map(tuple, behaviour.no_result_recovery(log, W).collect())) == outcomes


def test_sessions_paths_and_transitions(case):
    log, users = case
    found_sessions, paths, pairs = [], Counter(), Counter()
    for events in users:
        steps = ["no_result" if e[3] == "search" and e[4] == 0 else e[3] for e in events]
        pairs.update(zip(steps, steps[1:], strict=False))
        current = []
        for i, event in enumerate(events):
            current.append(i)
            if i + 1 == len(events) or events[i + 1][1] - event[1] > W:
                path = [steps[j] for j in current]
                searches = sum(events[j][3] == "search" for j in current)
                found_sessions.append(
                    (
                        event[2],
                        events[current[0]][1],
                        event[1],
                        len(current),
                        searches,
                        path.count("no_result"),
                        path.count("detail"),
                    )
                )
                paths[">".join(path[:3]), len(path) > 3] += 1
                current = []
    assert rows_of(sessions.search_sessions(log, W)) == sorted(found_sessions)
    counted = {tuple(r)[:2]: r["sessions"] for r in sessions.session_paths(log, W, 3).collect()}
    assert counted == paths
    counted = {tuple(r)[:2]: r["pairs"] for r in sessions.transitions(log).collect()}
    assert counted == pairs

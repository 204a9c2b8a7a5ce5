"""Patterns of consecutive steps in the timelines of users.

A pattern is a sequence of steps, such as `search no_result+ search detail`: the steps are those of
`functions.conditions.step`, and a `+` stands for one or more of a step in a row. A match is a run
of consecutive events of one user that reads like the pattern, from its first to its last event no
longer than a limit.

A pattern is a small automaton. Its state after an event is, per step of the pattern, the latest
start of a run that has come so far. A running maximum per step finds that, so all patterns take
one shuffle and one sort. Slices of a hot user's timeline are each summed up as a map from the
states before them to those after them; the maps are composed in order, and each slice then
starts from the states that earlier ones left.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seektrail.functions.conditions import step
from seektrail.plans.hot import spread_users, stored, timeline_keys

STEPS = ("search", "no_result", "detail", "other")
# A start later than any event's, which marks a run that began before a slice.
_BEFORE = "9999-12-31 23:59:59.999999"

Pattern = list[tuple[str, bool]]


def parse(text: str) -> Pattern:
    """The steps of a pattern and whether each may be repeated."""
    steps = [(word.removesuffix("+"), word.endswith("+")) for word in text.split()]
    unknown = [name for name, _ in steps if name not in STEPS]
    if unknown or not steps:
        raise ValueError(f"pattern {text!r} needs steps out of {', '.join(STEPS)}")
    return steps


def _advance(rows: DataFrame, parsed: list[Pattern], keys: list[str]) -> DataFrame:
    """Add `state`: per pattern and step the latest start of a run that ends here at that step.

    Rows without a time come first and carry the states before their part of a timeline in `entry`.
    """
    spec = Window.partitionBy(*keys).orderBy(F.col("ts").asc_nulls_first(), "event_id", "copy")
    running = spec.rowsBetween(Window.unboundedPreceding, 0)
    is_entry, at, places = F.col("ts").isNull(), 0, []
    for steps in parsed:
        before = F.col("ts")
        for name, repeated in steps:
            entry = F.get("entry", F.lit(at))
            fits, reached = F.col("step") == name, f"__s{at}"
            came = F.when(is_entry, entry).when(fits, before)
            if repeated:
                # Rows of one stretch of this step share a number, and numbers rise.
                stretch = F.count(F.when(is_entry | ~fits, 1)).over(running)
                rows = rows.withColumn("__run", F.struct(stretch.alias("n"), came.alias("start")))
                latest = F.max("__run").over(running)["start"]
                rows = rows.withColumn(reached, F.when(is_entry, entry).when(fits, latest))
            else:
                rows = rows.withColumn(reached, came)
            before = F.lag(reached).over(spec)
            places.append(reached)
            at += 1
    return rows.withColumn("state", F.array(*places)).drop("__run", *places)


def _entries(steps: DataFrame, parsed: list[Pattern]) -> DataFrame:
    """The states (user_id, slice, entry) that earlier slices of a hot user leave to each slice."""
    kind = steps.schema["ts"].dataType
    states = [(p, j) for p, pattern in enumerate(parsed) for j in range(len(pattern))]
    before, nothing = F.lit(_BEFORE).cast(kind), F.lit(None).cast(kind)
    # Lane 0 starts from nothing, lane j + 1 from every pattern having come to step j.
    lanes = range(max(len(p) for p in parsed) + 1)
    starts = F.array(
        *[F.array(*[before if j + 1 == lane else nothing for _, j in states]) for lane in lanes]
    )
    hot = steps.filter("slice > 0").withColumn("lane", F.explode(F.lit([*lanes])))
    heads = hot.select("user_id", "slice", "lane").distinct().withColumn("entry", F.get(starts, F.col("lane")))
    rows = hot.unionByName(heads, allowMissingColumns=True)
    keys = ["user_id", "slice", "lane"]
    place = F.struct("ts", "event_id", "copy")
    after = _advance(rows, parsed, keys).groupBy(*keys).agg(F.max_by("state", place).alias("state"))
    maps = after.groupBy("user_id", "slice").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lane", "state"))), lambda x: x["state"]).alias("lanes")
    )

    def through(vector: Column, lanes: Column) -> Column:
        """The states after a slice: those begun in it and those that came through it."""
        out = []
        for f, (p, _) in enumerate(states):
            came = [
                F.when(F.get(F.get(lanes, F.lit(j + 1)), F.lit(f)) == before, F.get(vector, F.lit(g)))
                for g, (q, j) in enumerate(states)
                if q == p
            ]
            out.append(F.greatest(F.get(F.get(lanes, F.lit(0)), F.lit(f)), *came, nothing))
        return F.array(*out)

    # A user has few slices, so their maps fit one row.
    ordered = maps.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("slice", "lanes"))).alias("slices")
    )
    none = F.array(*[nothing for _ in states])
    start = F.struct(
        none.alias("vector"),
        F.filter(F.array(F.struct(F.lit(0).alias("slice"), none.alias("entry"))), lambda x: F.lit(False)).alias("out"),
    )
    composed = F.aggregate(
        "slices",
        start,
        lambda acc, x: F.struct(
            through(acc["vector"], x["lanes"]).alias("vector"),
            F.concat(
                acc["out"], F.array(F.struct(x["slice"].alias("slice"), acc["vector"].alias("entry")))
            ).alias("out"),
        ),
    )
    return stored(ordered.select("user_id", F.inline(composed["out"])), "entries")


def pattern_matches(log: DataFrame, patterns: Mapping[str, str], within: timedelta) -> DataFrame:
    """Every event that completes a pattern: pattern (its name), user_id, event_id, started, ended.

    Of several runs that end at an event, the latest start counts; a match lasts `within` at most.
    Events without a user or a time take no part. A log without events gives no rows.
    """
    parsed = [parse(text) for text in patterns.values()]
    log = spread_users(log)
    kept = [c for c in ("slice",) if c in log.columns]
    steps = log.filter("user_id is not null and ts is not null").select(
        "user_id", "ts", "event_id", step().alias("step"), F.lit(0).alias("copy"), *kept
    )
    if kept:
        # Equal rows of one event keep one order in all passes.
        steps = steps.withColumn("copy", F.row_number().over(
            Window.partitionBy(*timeline_keys(log)).orderBy("ts", "event_id", "step")
        ))
    none = F.lit(None).cast("array<{}>".format(steps.schema["ts"].dataType.simpleString()))
    rows = steps.withColumn("entry", none)
    if kept:
        rows = rows.unionByName(_entries(steps, parsed), allowMissingColumns=True)
    advanced = _advance(rows, parsed, timeline_keys(log)).filter("ts is not null")
    ends, at = [], -1
    for name, pattern in zip(patterns, parsed, strict=True):
        at += len(pattern)
        ends.append(F.struct(F.lit(name).alias("pattern"), F.get("state", F.lit(at)).alias("started")))
    found = advanced.select("user_id", "event_id", F.col("ts").alias("ended"), F.inline(F.array(*ends)))
    found = found.filter(F.col("ended") <= F.col("started") + F.lit(within))
    return found.select("pattern", "user_id", "event_id", "started", "ended")


def journey_patterns(log: DataFrame, patterns: Mapping[str, str], within: timedelta) -> DataFrame:
    """Per pattern with a match: pattern, matches, users and first_match, the end of the first one."""
    return pattern_matches(log, patterns, within).groupBy("pattern").agg(
        F.count(F.lit(1)).alias("matches"),
        F.count_distinct("user_id").alias("users"),
        F.min("ended").alias("first_match"),
    )

"""Sessions, step-to-step transitions and session paths.

Events of a user exactly `gap` apart still belong to one session. Sessions are found with running
windows and not with `session_window`, which brings all events of a user to one task and cannot be
cut into slices.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seektrail.functions.conditions import step
from seektrail.plans.hot import spread_users, timeline_keys
from seektrail.plans.neighbours import link, neighbour, timeline


def _steps(log: DataFrame) -> DataFrame:
    kept = [c for c in ("slice",) if c in log.columns]
    return spread_users(log.select("user_id", "event_id", "ts", step().alias("step"), *kept))


def _parts(steps: DataFrame, gap: timedelta, *aggregates: Column) -> DataFrame:
    """Aggregates per part of a session: all of it, or what lies in one slice of a hot user.

    Rows carry `position`, their place in the part counted from 0. With slices, `session` numbers
    the sessions of a user and `offset` counts the session's events in earlier parts.
    """
    steps = steps.filter("user_id is not null")
    spec = timeline(steps)
    running = spec.rowsBetween(Window.unboundedPreceding, 0)
    starts = F.col("prev").isNull() | (F.col("ts") > F.col("prev.ts") + F.lit(gap))
    parts = (
        link(steps, "prev", ["ts"])
        .withColumn("starts", starts)
        .withColumn("part", F.count(F.when(F.col("starts"), 1)).over(running))
        .withColumn("row", F.row_number().over(spec))
        .withColumn("first", F.last(F.when(F.col("starts"), F.col("row")), True).over(running))
        .withColumn("position", F.col("row") - F.coalesce("first", F.lit(1)))
        .groupBy(*timeline_keys(steps), "part")
        .agg(F.count(F.lit(1)).alias("events"), *aggregates)
    )
    if "slice" not in steps.columns:
        return parts
    # Part 0 of a slice goes on with the last session of the slice before it. A user has no more
    # parts than sessions and slices, so these windows stay short.
    so_far = (
        Window.partitionBy("user_id")
        .orderBy("slice", "part")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    is_first = F.col("part") > 0
    seen_at_start = F.last(F.when(is_first, F.col("seen")), True).over(so_far)
    return (
        parts.withColumn("session", F.count(F.when(is_first, 1)).over(so_far))
        .withColumn("seen", F.sum("events").over(so_far) - F.col("events"))
        .withColumn("offset", F.col("seen") - seen_at_start)
    )


def search_sessions(log: DataFrame, gap: timedelta) -> DataFrame:
    """One row per session: its user, limits and counts of events by step.

    An event without a user is a session of its own.
    """
    steps = {
        "searches": ("search", "no_result"),
        "no_results": ("no_result",),
        "details": ("detail",),
    }
    every = _steps(log)
    found = _parts(
        every,
        gap,
        F.min("ts").alias("session_start"),
        F.max("ts").alias("session_end"),
        *[F.count_if(F.col("step").isin(*v)).alias(k) for k, v in steps.items()],
    )
    counts = ("events", *steps)
    if "slice" in found.columns:
        found = found.groupBy("user_id", "session").agg(
            F.min("session_start").alias("session_start"),
            F.max("session_end").alias("session_end"),
            *[F.sum(c).alias(c) for c in counts],
        )
    alone = every.filter("user_id is null").select(
        "user_id",
        F.col("ts").alias("session_start"),
        F.col("ts").alias("session_end"),
        F.lit(1).cast("bigint").alias("events"),
        *[F.coalesce(F.col("step").isin(*v), F.lit(False)).cast("bigint").alias(k) for k, v in steps.items()],
    )
    return found.select("user_id", "session_start", "session_end", *counts).unionByName(alone)


def transitions(log: DataFrame) -> DataFrame:
    """How often each step was directly followed by each other step of the same user."""
    return (
        neighbour(_steps(log), "next", ["step"], ahead=True)
        .filter(F.col("next").isNotNull())
        .groupBy("step", F.col("next.step").alias("next_step"))
        .agg(F.count(F.lit(1)).alias("pairs"))
    )


def session_paths(log: DataFrame, gap: timedelta, max_len: int) -> DataFrame:
    """How many sessions took each path, the path being the first `max_len` steps in order.

    `longer` tells whether the sessions went on after that. At most `max_len` steps of a session
    are ever brought together, however long it is. An event without a user is a session.
    """
    every = _steps(log)
    head = F.when(F.col("position") < max_len, F.struct("position", "step"))
    found = _parts(every, gap, F.sort_array(F.collect_list(head))["step"].alias("head"))
    if "slice" in found.columns:
        useful = F.when(F.col("offset") < max_len, F.struct("offset", "head"))
        heads = F.sort_array(F.collect_list(useful))["head"]
        found = found.groupBy("user_id", "session").agg(
            F.slice(F.flatten(heads), 1, max_len).alias("head"), F.sum("events").alias("events")
        )
    alone = every.filter("user_id is null").select(
        F.slice(F.array("step"), 1, max_len).alias("head"), F.lit(1).cast("bigint").alias("events")
    )
    found = found.select("head", "events").unionByName(alone)
    longer = F.col("events") > max_len
    return found.groupBy(F.array_join("head", ">").alias("path"), longer.alias("longer")).agg(
        F.count(F.lit(1)).alias("sessions")
    )

"""What people do around searches: no results, searching again, changing conditions, details.

All operators take a search log (`seektrail.sources.model.SEARCH_LOG_SCHEMA`). A user's events
are ordered by (ts, event_id). Time limits are inclusive.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seektrail.functions.conditions import changed_fields, is_search, no_result
from seektrail.plans.hot import spread_users
from seektrail.plans.neighbours import neighbour

def no_result_rate(log: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Searches, no-result searches and their rate per group.

    Searches with unknown `result_count` are left out; the quality rules report them.
    """
    return (
        log.filter(is_search() & F.col("result_count").isNotNull())
        .groupBy(*by)
        .agg(F.count(F.lit(1)).alias("searches"), F.count_if(no_result()).alias("no_result"))
        .withColumn("rate", F.col("no_result") / F.col("searches"))
    )


def _searches_with_previous(log: DataFrame, within: timedelta, *fields: str) -> DataFrame:
    """Searches with struct `prev`, the user's previous search if at most `within` ago."""
    columns = ["user_id", "event_id", "ts", *fields]
    searches = spread_users(log.filter(is_search()).select(*columns, *_slice(log)))
    linked = neighbour(searches, "prev", ["event_id", "ts", *fields])
    recent = F.col("ts") <= F.col("prev.ts") + F.lit(within)
    return linked.withColumn("prev", F.when(recent, F.col("prev")))


def _slice(log: DataFrame) -> list[str]:
    return [c for c in ("slice",) if c in log.columns]


def re_search(log: DataFrame, within: timedelta) -> DataFrame:
    """One row per search: does it follow the user's previous search within the limit?"""
    return _searches_with_previous(log, within, "result_count").select(
        "event_id",
        "user_id",
        "ts",
        F.col("prev.event_id").alias("prev_event_id"),
        F.col("prev").isNotNull().alias("is_re_search"),
        (F.col("prev.result_count") == 0).alias("after_no_result"),
    )


def condition_change(log: DataFrame, within: timedelta) -> DataFrame:
    """One row per re-search with the sorted names of the condition fields that changed.

    A field that appears or disappears has changed. An empty list is a repeated search.
    """
    return (
        _searches_with_previous(log, within, "cond")
        .filter(F.col("prev").isNotNull())
        .select(
            "event_id",
            "user_id",
            "ts",
            F.col("prev.event_id").alias("prev_event_id"),
            changed_fields(F.col("prev.cond"), F.col("cond")).alias("changed"),
        )
    )


def _searches_with_next(log: DataFrame, within: timedelta) -> DataFrame:
    """Searches with struct `next`, the user's next search or detail if at most `within` later."""
    steps = spread_users(
        log.filter(F.col("kind").isin("search", "detail")).select(
            "user_id", "event_id", "ts", "kind", "result_count", *_slice(log)
        )
    )
    linked = neighbour(
        steps, "next", ["event_id", "ts", "kind", "result_count"], ahead=True
    )
    soon = F.col("next.ts") <= F.col("ts") + F.lit(within)
    return linked.filter(is_search()).withColumn("next", F.when(soon, F.col("next")))


def detail_entry(log: DataFrame, within: timedelta) -> DataFrame:
    """One row per search: the first detail view within the limit and before the next search."""
    detail = F.when(F.col("next.kind") == "detail", F.col("next"))
    return _searches_with_next(log, within).select(
        "event_id",
        "user_id",
        "ts",
        "result_count",
        detail.isNotNull().alias("entered"),
        detail["event_id"].alias("detail_event_id"),
        detail["ts"].alias("detail_ts"),
    )


def no_result_recovery(log: DataFrame, within: timedelta) -> DataFrame:
    """How many no-result searches were followed by what.

    Outcomes: `detail`, `results` (a search with results), `no_result` (another one without),
    `unknown` (a search whose result count is missing) and `abandoned` (neither search nor
    detail within the limit).
    """
    outcome = (
        F.when(F.col("next").isNull(), "abandoned")
        .when(F.col("next.kind") == "detail", "detail")
        .when(F.col("next.result_count") == 0, "no_result")
        .when(F.col("next.result_count") > 0, "results")
        .otherwise("unknown")
    )
    return (
        _searches_with_next(log, within)
        .filter(no_result())
        .groupBy(outcome.alias("outcome"))
        .agg(F.count(F.lit(1)).alias("searches"))
    )


def detail_attribution(log: DataFrame, within: timedelta) -> DataFrame:
    """One row per detail view with the user's latest earlier search, if within the limit."""
    steps = spread_users(
        log.filter(F.col("kind").isin("search", "detail")).select(
            "user_id", "event_id", "ts", "kind", *_slice(log)
        )
    )
    linked = neighbour(steps, "search", ["event_id", "ts"], where=is_search())
    search = F.when(F.col("ts") <= F.col("search.ts") + F.lit(within), F.col("search"))
    return linked.filter(F.col("kind") == "detail").select(
        "event_id",
        "user_id",
        "ts",
        search["event_id"].alias("search_event_id"),
        search["ts"].alias("search_ts"),
    )


def no_result_conditions(log: DataFrame, n: int) -> DataFrame:
    """The `n` condition values (field, value) with the most no-result searches.

    Equal counts are ordered by field and value.
    """
    return (
        log.filter(is_search() & F.col("result_count").isNotNull())
        .select("result_count", "kind", F.explode("cond").alias("field", "value"))
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("searches"), F.count_if(no_result()).alias("no_result"))
        .withColumn("rate", F.col("no_result") / F.col("searches"))
        .orderBy(F.desc("no_result"), "field", "value")
        .limit(n)
    )

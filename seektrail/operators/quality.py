"""Declared data-quality rules, the report on them and the quarantine of failing rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seektrail.plans.hot import join_parent


@dataclass(frozen=True)
class RowRule:
    """A rule that each row passes or fails on its own; `fails` is true for a failing row.

    The conditions are functions so that rules can be declared before there is a session.
    """

    name: str
    table: str
    applies: Callable[[], Column]
    fails: Callable[[], Column]


@dataclass(frozen=True)
class UniqueKey:
    name: str
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    """`columns` must be found among `parent_columns`; null references pass."""

    name: str
    table: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class TimeOrder:
    """`time` must not be before `parent_time` of the referenced row."""

    name: str
    table: str
    columns: tuple[str, ...]
    time: str
    parent: str
    parent_columns: tuple[str, ...]
    parent_time: str


def not_null(table: str, column: str) -> RowRule:
    return RowRule(
        f"{column} not null", table, lambda: F.lit(True), lambda: F.col(column).isNull()
    )


def in_range(table: str, column: str, low: object, high: object) -> RowRule:
    """Values lie in [low, high]; nulls pass."""
    return RowRule(
        f"{column} in range",
        table,
        lambda: F.col(column).isNotNull(),
        lambda: ~F.col(column).between(low, high),
    )


def matches(table: str, column: str, pattern: str) -> RowRule:
    """The pattern is found in the text; nulls pass."""
    return RowRule(
        f"{column} format",
        table,
        lambda: F.col(column).isNotNull(),
        lambda: ~F.col(column).rlike(pattern),
    )


def _failed(rule: RowRule) -> Column:
    return F.coalesce(rule.applies() & rule.fails(), F.lit(False))


def check_rows(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """All row rules of a table in one aggregation: one row (rule, checked, failed) per rule."""
    results = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.count_if(r.applies()).alias("checked"),
            F.count_if(_failed(r)).alias("failed"),
        )
        for r in rules
    ]
    return df.agg(F.array(*results).alias("results")).select(F.inline("results"))


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The key values that occur more than once, with their number of rows."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def check_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows checked, and rows whose key is not theirs alone."""
    per_key = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        _sum(F.col("n")).alias("checked"), _sum_if("n", F.col("n") > 1).alias("failed")
    )


def orphans(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> DataFrame:
    """Child rows whose reference, though not null, has no parent."""
    present = child.dropna(subset=list(columns))
    keys = _named(parent, parent_columns, columns)
    return join_parent(present, keys, columns, "left_anti")


def check_reference(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> DataFrame:
    """References checked, and those without parent.

    Child rows are counted per key before the join, so a key with many rows is one row in it.
    """
    counts = child.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    keys = _named(parent, parent_columns, columns).distinct().withColumn("found", F.lit(True))
    return counts.join(keys, list(columns), "left").agg(
        _sum(F.col("n")).alias("checked"), _sum_if("n", F.col("found").isNull()).alias("failed")
    )


def too_early(
    child: DataFrame,
    columns: Sequence[str],
    time: str,
    parent: DataFrame,
    parent_columns: Sequence[str],
    parent_time: str,
) -> DataFrame:
    """Child rows with column `parent_time` added where it is later than their own `time`.

    Should a parent key occur more than once, its earliest time counts.
    """
    return _with_parent_time(child, columns, time, parent, parent_columns, parent_time).filter(
        F.col(time) < F.col("parent_time")
    )


def _with_parent_time(child, columns, time, parent, parent_columns, parent_time) -> DataFrame:
    times = (
        parent.select(*parent_columns, parent_time)
        .toDF(*columns, "parent_time")
        .dropna()
        .groupBy(*columns)
        .agg(F.min("parent_time").alias("parent_time"))
    )
    return join_parent(child.dropna(subset=[*columns, time]), times, columns)


def check_time_order(
    child: DataFrame,
    columns: Sequence[str],
    time: str,
    parent: DataFrame,
    parent_columns: Sequence[str],
    parent_time: str,
) -> DataFrame:
    """Child rows with a parent time to compare with, and those that are earlier."""
    pairs = _with_parent_time(
        child.select(*columns, time), columns, time, parent, parent_columns, parent_time
    )
    return pairs.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.col(time) < F.col("parent_time")).alias("failed"),
    )


def quality_report(
    tables: Mapping[str, DataFrame],
    rules: Sequence[RowRule | UniqueKey | Reference | TimeOrder],
) -> DataFrame:
    """One row (table, rule, checked, failed) per rule. A table's row rules share one pass."""
    results = []
    for table in dict.fromkeys(r.table for r in rules if isinstance(r, RowRule)):
        row_rules = [r for r in rules if isinstance(r, RowRule) and r.table == table]
        results.append(check_rows(tables[table], row_rules).withColumn("table", F.lit(table)))
    for rule in rules:
        if isinstance(rule, RowRule):
            continue
        child = tables[rule.table]
        if isinstance(rule, UniqueKey):
            result = check_unique(child, rule.columns)
        elif isinstance(rule, Reference):
            parent = tables[rule.parent]
            result = check_reference(child, rule.columns, parent, rule.parent_columns)
        else:
            parent = tables[rule.parent]
            result = check_time_order(
                child, rule.columns, rule.time, parent, rule.parent_columns, rule.parent_time
            )
        results.append(
            result.withColumn("rule", F.lit(rule.name)).withColumn("table", F.lit(rule.table))
        )
    return reduce(DataFrame.unionByName, results).select("table", "rule", "checked", "failed")


def quarantine(df: DataFrame, rules: Sequence[RowRule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and rejected rows with the names of the rules they fail in `failed_rules`."""
    failed = F.array_compact(F.array(*[F.when(_failed(r), F.lit(r.name)) for r in rules]))
    checked = df.withColumn("failed_rules", failed)
    valid = checked.filter(F.size("failed_rules") == 0).drop("failed_rules")
    return valid, checked.filter(F.size("failed_rules") > 0)


def _named(df: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    return df.select(*columns).toDF(*names)


def _sum(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def _sum_if(column: str, condition: Column) -> Column:
    return _sum(F.when(condition, F.col(column)))

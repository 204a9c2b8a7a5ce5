"""Current rows, and differences between two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by `order`.

    Rows equal in key and order are ranked by a hash of the whole row, so the choice does not
    depend on the layout of the data. Spark keeps one row per key and task before the shuffle.
    """
    last_first = [F.desc(c) for c in order]
    # Maps cannot be hashed, so their entries are.
    hashed = [
        F.array_sort(F.map_entries(c)) if kind.startswith("map") else F.col(c)
        for c, kind in df.dtypes
    ]
    window = Window.partitionBy(*key).orderBy(*last_first, F.xxhash64(*hashed))
    return df.withColumn("rank", F.row_number().over(window)).filter("rank = 1").drop("rank")


def snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key: `state` is added, removed, changed or same, `changed` names the columns.

    Values are compared null-safe, maps whatever the order of their entries. A column that only one
    version has counts as null in the other one. A key that occurs twice on one side raises an error when the
    result is computed. Both versions go through one aggregation by key, so even a repeated key
    never multiplies rows.
    """
    key = list(key)
    old, new = _aligned(old, new), _aligned(new, old)
    values = [c for c in old.columns if c not in key]
    row = F.struct(*values) if values else F.struct(F.lit(True).alias("present"))
    sides = (
        old.select(*key, row.alias("old"))
        .unionByName(new.select(*key, row.alias("new")), allowMissingColumns=True)
        .groupBy(*key)
        .agg(
            F.count("old").alias("n_old"),
            F.count("new").alias("n_new"),
            F.any_value("old", ignoreNulls=True).alias("old"),
            F.any_value("new", ignoreNulls=True).alias("new"),
        )
    )
    repeated = F.raise_error(F.concat(F.lit("repeated key "), F.to_json(F.struct(*key))))
    differing = F.array_compact(
        F.array(
            *[F.when(~F.col("old")[c].eqNullSafe(F.col("new")[c]), F.lit(c)) for c in values]
        ).cast("array<string>")
    )
    state = (
        F.when(F.col("n_old") == 0, "added")
        .when(F.col("n_new") == 0, "removed")
        .when(F.size("changed") > 0, "changed")
        .otherwise("same")
    )
    # In a filter, which is evaluated also where nothing but the number of rows is asked for.
    twice = (F.col("n_old") > 1) | (F.col("n_new") > 1)
    sides = sides.filter(F.when(twice, repeated.cast("boolean")).otherwise(F.lit(True)))
    both = (F.col("n_old") > 0) & (F.col("n_new") > 0)
    nothing = F.array().cast("array<string>")
    return sides.withColumn("changed", F.when(both, differing).otherwise(nothing)).select(
        *key, state.alias("state"), "changed"
    )


def _aligned(df: DataFrame, other: DataFrame) -> DataFrame:
    """`df` with the columns that only `other` has, null, and maps as sorted entries."""
    missing = [f for f in other.schema.fields if f.name not in df.columns]
    df = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    maps = [c for c, kind in df.dtypes if kind.startswith("map")]
    return df.withColumns({c: F.array_sort(F.map_entries(c)) for c in maps})


def key_history(versions: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The states of each key and the versions between which it held them.

    `versions` holds the rows of all versions of a table, told apart by the column `version`. Returns
    the table's columns with valid_from, the first version of a state, and valid_to, the first version
    that no longer has it, null while it lasts. The same state in versions that follow each
    other is one row; a key that was gone for a version has a row before and one after.
    A key that a version holds twice with different values is an error; repeated rows are one.

    One shuffle by key. The list of versions, one row each, is sent to the rows, which stay where they are: a
    version may hold any share of them.
    """
    values = [c for c in versions.columns if c != version]
    names = versions.select(version).distinct()
    ordered = Window.orderBy(version)
    # One row per version.
    numbers = names.select(
        version,
        F.row_number().over(ordered).alias("__number"),
        F.lead(version).over(ordered).alias("__after"),
    )
    kinds = dict(versions.dtypes)
    state = F.md5(
        F.to_json(
            F.struct(
                *[
                    (F.array_sort(F.map_entries(c)) if kinds[c].startswith("map") else F.col(c)).alias(c)
                    for c in values
                ]
            ),
            {"ignoreNullFields": "false"},
        )
    )
    rows = versions.join(F.broadcast(numbers), version).withColumn("__state", state)
    timeline = Window.partitionBy(*key).orderBy("__number")
    before = F.lag(F.struct("__number", "__state")).over(timeline)
    twice = (before["__number"] == F.col("__number")) & (before["__state"] != F.col("__state"))
    clash = F.raise_error(F.concat(F.lit("a version holds a key twice: "), F.to_json(F.struct(*key))))
    goes_on = (before["__number"] >= F.col("__number") - 1) & (before["__state"] == F.col("__state"))
    begins = F.when(twice, clash.cast("boolean")).otherwise(F.coalesce(~goes_on, F.lit(True)))
    running = timeline.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__begins", begins)
    rows = rows.withColumn("__stretch", F.count(F.when(F.col("__begins"), 1)).over(running))
    held = [F.first(c).alias(c) for c in values if c not in key]
    return (
        rows.groupBy(*key, "__stretch")
        .agg(*held, F.min(version).alias("valid_from"), F.max_by("__after", "__number").alias("valid_to"))
        .select(*values, "valid_from", "valid_to")
    )


def as_of(df: DataFrame, history: DataFrame, key: Sequence[str], when: str) -> DataFrame:
    """The rows of `df` with the state that their key had as of their column `when`.

    A join on the key within the bounds valid_from (included) and valid_to (not included). Rows whose
    key had no state then keep nulls. `df` may have other columns only if the history does not.
    """
    states = history.withColumnsRenamed({k: f"__{k}" for k in key})
    holds = (F.col("valid_from") <= df[when]) & (F.col("valid_to").isNull() | (df[when] < F.col("valid_to")))
    for k in key:
        holds = holds & (df[k] == states[f"__{k}"])
    return df.join(states, holds, "left").drop(*[f"__{k}" for k in key])

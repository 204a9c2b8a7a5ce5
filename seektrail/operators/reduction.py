"""Making related tables smaller while keys and references stay intact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seektrail.functions.hashing import KEY_SPACE, key_hash
from seektrail.plans.hot import join_parent, stored
from seektrail.sources.model import ForeignKey


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """Rows, non-nulls, distinct values, bytes and longest value (as text) per column.

    The exact form counts each (column, value) first; `approx=True` makes one pass without
    shuffling values and estimates `distinct`.
    """
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    if approx:
        results = [
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("rows"),
                F.count(c).alias("non_null"),
                F.approx_count_distinct(c).alias("distinct"),
                F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias("bytes"),
                F.max(F.octet_length(c)).alias("max_length"),
            )
            for c in df.columns
        ]
        return text.agg(F.array(*results).alias("results")).select(F.inline("results"))
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in df.columns]
    size = F.octet_length("value").cast("bigint")
    return (
        text.select(F.inline(F.array(*pairs)))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias(
                "non_null"
            ),
            F.count("value").alias("distinct"),
            F.coalesce(F.sum(F.col("n") * size), F.lit(0)).alias("bytes"),
            F.max(size).cast("int").alias("max_length"),
        )
    )


def referential_subset(
    tables: Mapping[str, DataFrame],
    fks: Sequence[ForeignKey],
    root: str,
    root_key: str,
    fraction: float | None = None,
    root_rows: int | None = None,
) -> dict[str, DataFrame]:
    """A hash-chosen part of the root rows, and the child rows all of whose parents are kept.

    The part is either a `fraction` of the keys (0 to 1) or the `root_rows` rows lowest by (hash,
    key). A child row stays if every reference to a reduced table finds its parent. A null
    reference is no reference, except for a child's first listed one: rows that
    belong to nothing are left out. Tables not below the root are kept whole. Where a reference of the
    root key's own type is to the root's key, its hash thins out the child before the join.
    """
    if (fraction is None) == (root_rows is None):
        raise ValueError("give either fraction or root_rows")
    if fraction is not None and not 0 <= fraction <= 1:
        raise ValueError(f"fraction is not between 0 and 1: {fraction}")
    if root_rows is not None and root_rows < 0:
        raise ValueError(f"root_rows is negative: {root_rows}")
    limit = None if fraction is None else int(fraction * KEY_SPACE)
    if limit is None:
        chosen = tables[root].orderBy(key_hash(root_key), root_key).limit(root_rows)
        chosen = stored(chosen, "root")
    else:
        chosen = tables[root].filter(key_hash(root_key) < limit)
    reduced = {root: chosen}
    waiting = _references_below(tables, fks, root)
    while waiting:
        ready = [c for c, own in waiting.items() if all(fk.parent in reduced for fk in own)]
        if not ready:
            raise ValueError(f"references in a circle: {waiting}")
        for name in ready:
            child = tables[name]
            for number, fk in enumerate(waiting.pop(name)):
                same_type = (
                    child.schema[fk.child_cols[0]].dataType == tables[root].schema[root_key].dataType
                )
                if limit is not None and (fk.parent, fk.parent_cols) == (root, (root_key,)):
                    below = key_hash(fk.child_cols[0]) < limit
                    if same_type:
                        child = child.filter(below | F.lit(number > 0) & F.col(fk.child_cols[0]).isNull())
                parents = reduced[fk.parent].select(*fk.parent_cols).toDF(*fk.child_cols)
                nothing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in fk.child_cols])
                found = join_parent(child, parents, fk.child_cols, "left_semi").select(*child.columns)
                if number and any(child.schema[c].nullable for c in fk.child_cols):
                    found = found.unionByName(child.filter(nothing))
                child = found
            reduced[name] = child
    return {name: reduced.get(name, df) for name, df in tables.items()}


def _references_below(
    tables: Mapping[str, DataFrame], fks: Sequence[ForeignKey], root: str
) -> dict[str, list[ForeignKey]]:
    """For each table below the root, its references to the root or to tables below it."""
    fks = [fk for fk in fks if {fk.child, fk.parent} <= set(tables) and fk.child != fk.parent]
    below = {root}
    while found := {fk.child for fk in fks if fk.parent in below} - below:
        below |= found
    own: dict[str, list[ForeignKey]] = {}
    for fk in fks:
        if fk.parent in below and fk.child != root:
            own.setdefault(fk.child, []).append(fk)
    return own


def broken_references(tables: Mapping[str, DataFrame], fks: Sequence[ForeignKey]) -> DataFrame:
    """Rows per foreign key (child, columns, parent) whose non-null reference finds no parent."""
    found = []
    for fk in fks:
        if {fk.child, fk.parent} <= set(tables):
            child = tables[fk.child].select(*fk.child_cols).dropna()
            parents = tables[fk.parent].select(*fk.parent_cols).toDF(*fk.child_cols).distinct()
            lost = child.groupBy(*fk.child_cols).agg(F.count(F.lit(1)).alias("n"))
            lost = lost.join(parents, list(fk.child_cols), "left_anti")
            names = [F.lit(fk.child), F.lit(",".join(fk.child_cols)), F.lit(fk.parent)]
            rows = F.coalesce(F.sum("n"), F.lit(0)).alias("broken")
            found.append(
                lost.agg(rows).select(
                    *[n.alias(a) for n, a in zip(names, ("child", "columns", "parent"), strict=True)],
                    "broken",
                )
            )
    return reduce(DataFrame.unionByName, found)


def sample_drift(
    full: DataFrame, subset: DataFrame, metrics: Mapping[str, Column]
) -> DataFrame:
    """Each metric (an aggregate giving a number) in the full and the reduced data."""

    def measured(df: DataFrame, side: str) -> DataFrame:
        values = [
            F.struct(F.lit(k).alias("metric"), m.cast("double").alias(side))
            for k, m in metrics.items()
        ]
        return df.agg(F.array(*values).alias("values")).select(F.inline("values"))

    both = measured(full, "full").unionByName(
        measured(subset, "subset"), allowMissingColumns=True
    )
    return (
        both.groupBy("metric")
        .agg(F.max("full").alias("full"), F.max("subset").alias("subset"))
        .withColumn("difference", F.col("subset") - F.col("full"))
    )


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """The distinct non-null values of a text column with ids 1..n, columns (value, id).

    Ids follow the order of (md5, value). They are numbered within each of 4096 ranges of the
    md5, then shifted by the number of values in earlier ranges, so no task sees all values.
    """
    digest = F.md5("value")
    values = (
        df.select(F.col(column).alias("value"))
        .filter(F.col("value").isNotNull())
        .distinct()
        .withColumn("range", F.conv(F.substring(digest, 1, 3), 16, 10).cast("int"))
    )
    in_range = Window.partitionBy("range").orderBy(digest, "value")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        values.groupBy("range")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    )
    # One row per range, so 4096 rows at most.
    return (
        values.withColumn("place", F.row_number().over(in_range))
        .join(F.broadcast(shifts), "range")
        .select("value", (F.col("shift") + F.col("place")).alias("id"))
    )


def dictionary_encode(
    df: DataFrame, columns: Sequence[str]
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The table with text columns replaced by ids, and a dictionary for each column.

    Dictionaries are stored: they are used more than once, and costly to derive.
    """
    dictionaries = {c: stored(dictionary(df, c), "dictionary") for c in columns}
    return _replaced(df, dictionaries, "value", "id"), dictionaries


def dictionary_decode(encoded: DataFrame, dictionaries: Mapping[str, DataFrame]) -> DataFrame:
    """Puts the values back in place of the ids. An id that is not in its dictionary is an error."""
    return _replaced(encoded, dictionaries, "id", "value")


def _replaced(
    df: DataFrame, dictionaries: Mapping[str, DataFrame], old: str, new: str
) -> DataFrame:
    """Spark decides by the stored dictionary's size whether to broadcast it."""
    replaced = df
    for column, words in dictionaries.items():
        lookup = words.select(F.col(old).alias(column), F.col(new).alias("new"))
        joined = join_parent(replaced, lookup, [column], "left", counted=df)
        unknown = F.raise_error(F.concat(F.lit(f"not in the dictionary of {column}: "), column))
        missing = F.col("new").isNull() & F.col(column).isNotNull()
        value = F.when(missing, unknown.cast(lookup.schema["new"].dataType)).otherwise(F.col("new"))
        replaced = joined.withColumn("new", value).drop(column).withColumnRenamed("new", column)
    return replaced.select(*df.columns)


def table_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that the two tables hold in different numbers, with `copies_a` and `copies_b`.

    Both are counted together in one partial aggregation. Nulls equal nulls.
    """
    sides = a.withColumns({"in_a": F.lit(1), "in_b": F.lit(0)}).unionByName(
        b.withColumns({"in_a": F.lit(0), "in_b": F.lit(1)})
    )
    return (
        sides.groupBy(*a.columns)
        .agg(F.sum("in_a").alias("copies_a"), F.sum("in_b").alias("copies_b"))
        .filter("copies_a <> copies_b")
    )


def assert_same(a: DataFrame, b: DataFrame) -> None:
    """Raises unless both tables hold the same rows in the same numbers, in any order."""
    if sorted(a.dtypes) != sorted(b.dtypes):
        raise AssertionError(f"different columns: {a.dtypes} and {b.dtypes}")
    different = table_differences(a, b).take(5)
    if different:
        raise AssertionError(f"different rows, among them {different}")

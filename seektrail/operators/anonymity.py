"""Generalising columns that could single people out until every class holds enough rows.

The space of the columns is cut at medians, level by level. What is cut are places, the distinct
combinations of the columns' codes with their numbers of rows; rows are aggregated once. A column
has at most `bins` codes, so no task holds more than the counts of one column in one class. A class of few
places is cut to its end by one task; many such classes are cut at the same time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seektrail.plans.hot import join_parent, stored

BINS = 1024
# A level at most doubles the classes: so many cuts, of three numbers each, are sent to all tasks.
BROADCAST_LEVELS = 16
MAX_LEVELS = 60
# A class of at most so many places is cut on by one task.
LOCAL_PLACES = 50_000


def _codes(df: DataFrame, quasi: Sequence[str], bins: int) -> list[Column]:
    """The bin of each column between its least and largest value; null and NaN have bin -1.

    Runs one job, which brings two numbers per column to the driver.
    """
    kinds = dict(df.dtypes)
    for c in quasi:
        if kinds[c] not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
            raise ValueError(f"not a number: {c} is {kinds[c]}")
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in quasi]
    ends = df.agg(*[f(v) for v in values for f in (F.min, F.max)]).first()
    codes = []
    for i, v in enumerate(values):
        low, high = ends[2 * i], ends[2 * i + 1]
        if low is None or low == high:
            code = F.lit(0)
        else:
            code = F.least(F.floor((v - low) * bins / (high - low)), F.lit(bins - 1))
        codes.append(F.when(v.isNull(), -1).otherwise(code).cast("int").alias(f"__c{i}"))
    return codes


def _cuts(places: DataFrame, dims: int, k: int) -> DataFrame:
    """(class, dim, cut, lower, upper) per class that can be cut with at least k rows on both sides.

    Of the columns whose lower median allows that, the one with the widest range of codes is cut,
    the first listed among equals. `lower` and `upper` are the numbers of places on both sides.
    """
    each = [F.struct(F.lit(i).alias("dim"), F.col(f"__c{i}").alias("code")) for i in range(dims)]
    counts = (
        places.select("class", "n", F.explode(F.array(*each)).alias("at"))
        .groupBy("class", F.col("at.dim").alias("dim"), F.col("at.code").alias("code"))
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"))
    )
    # At most one row per code of the column.
    column = Window.partitionBy("class", "dim")
    upto = column.orderBy("code")
    found = counts.withColumns({
        "below": F.sum("n").over(upto),
        "all": F.sum("n").over(column),
        "lower": F.sum("places").over(upto),
    })
    middle = F.when(2 * F.col("below") >= F.col("all"), F.struct("code", "below", "lower"))
    chosen = (
        found.groupBy("class", "dim")
        .agg(
            F.min(middle).alias("middle"),
            F.max("all").alias("all"),
            F.sum("places").alias("places"),
            (F.max("code") - F.min("code")).alias("span"),
        )
        .filter((F.col("middle.below") >= k) & (F.col("all") - F.col("middle.below") >= k))
    )
    cut = F.struct(
        "dim",
        F.col("middle.code").alias("cut"),
        F.col("middle.lower").alias("lower"),
        (F.col("places") - F.col("middle.lower")).alias("upper"),
    )
    best = F.max_by(cut, F.struct("span", -F.col("dim")))
    return chosen.groupBy("class").agg(best.alias("best")).select("class", "best.*")


def _cut_to_the_end(dims: int, k: int, levels: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Cuts the places of one class as `_cuts` says, all classes that come of it side by side."""

    def cut(places: pd.DataFrame) -> pd.DataFrame:
        codes = places[[f"__c{i}" for i in range(dims)]].to_numpy("int64")
        rows, label = places["n"].to_numpy("int64"), places["class"].to_numpy("int64").copy()
        left = np.arange(len(label))
        for _ in range(levels + 1 - int(label[0]).bit_length()):
            group = np.unique(label[left], return_inverse=True)[1]
            span, dim, at = (np.full(group.max() + 1, -1) for _ in range(3))
            for i in range(dims):
                order = np.lexsort((codes[left, i], group))
                g, c, below = group[order], codes[left, i][order], np.cumsum(rows[left][order])
                first = np.flatnonzero(np.diff(g, prepend=-1))
                last = np.append(first[1:], len(g)) - 1
                start = np.append(0, below[last[:-1]])
                total = below[last] - start
                below = below - start[g]
                middle = first + np.add.reduceat(2 * below < total[g], first, dtype="int64")
                ends = np.flatnonzero((np.diff(g, append=-1) != 0) | (np.diff(c, append=-2) != 0))
                lower = below[ends[np.searchsorted(ends, middle)]]
                best = (lower >= k) & (total - lower >= k) & (c[last] - c[first] > span)
                span[best], dim[best], at[best] = (c[last] - c[first])[best], i, c[middle][best]
            goes_on = dim[group] >= 0
            left, group = left[goes_on], group[goes_on]
            if not len(left):
                break
            label[left] = 2 * label[left] + (codes[left, dim[group]] > at[group])
        return places.drop(columns="n").assign(**{"class": label})

    return cut


def _classed(
    df: DataFrame, quasi: Sequence[str], sensitive: str, k: int, levels: int, bins: int
) -> tuple[DataFrame, DataFrame]:
    """The cells of `df` (codes, value of `sensitive`, least and largest values, n) and the `class` of their codes."""
    if k < 1:
        raise ValueError(f"a class must hold at least one row: {k}")
    if not 0 <= levels <= MAX_LEVELS:
        raise ValueError(f"levels are not between 0 and {MAX_LEVELS}: {levels}")
    dims = len(quasi)
    names = [f"__c{i}" for i in range(dims)]
    ends = [f(c).alias(f"__{e}{i}") for i, c in enumerate(quasi) for e, f in (("from", F.min), ("to", F.max))]
    coded = df.select(*_codes(df, quasi, bins), *quasi, F.col(sensitive).alias("__sensitive"))
    cells = stored(coded.groupBy(*names, "__sensitive").agg(F.count(F.lit(1)).alias("n"), *ends), "cells")
    places = cells.groupBy(*names).agg(F.sum("n").alias("n")).withColumn("class", F.lit(1).cast("bigint"))
    places = stored(places, "places")
    size = places.count()
    # Of the places, those that all tasks cut together, those that one task cuts on, and those that are done.
    together, alone, done = places.filter(F.lit(size > LOCAL_PLACES)), [places.filter(F.lit(size <= LOCAL_PLACES))], []
    for level in range(levels):
        if together.isEmpty():
            break
        cuts = stored(_cuts(together, dims, k), "cuts")
        code = F.element_at(F.array(*names), F.col("dim") + 1)
        upper = F.when(code > F.col("cut"), 1).otherwise(0)
        is_cut = F.col("dim").isNotNull()
        size = F.when(upper == 1, F.col("upper")).otherwise(F.col("lower"))
        # Who cuts it on: nobody (0), one task (1), all (2).
        to = F.when(~is_cut, 0).when(size <= LOCAL_PLACES, 1).otherwise(2)
        side = F.when(is_cut, 2 * F.col("class") + upper).otherwise(F.col("class"))
        small = F.broadcast(cuts) if level <= BROADCAST_LEVELS else cuts
        joined = together.join(small, "class", "left").select(*names, "n", side.alias("class"), to.alias("to"))
        joined = stored(joined, "places")
        together, one, none = (joined.filter(F.col("to") == t).drop("to") for t in (2, 1, 0))
        alone.append(one)
        done.append(none)
    cut_on = reduce(DataFrame.unionByName, alone).groupBy("class")
    kinds = ", ".join(f"{c} int" for c in names)
    ready = cut_on.applyInPandas(_cut_to_the_end(dims, k, levels), f"{kinds}, class bigint")
    rest = [part.drop("n") for part in (*done, together)]
    return cells, stored(reduce(DataFrame.unionByName, rest, ready), "places")


def anonymous_classes(
    df: DataFrame, quasi: Sequence[str], sensitive: str, k: int, levels: int = MAX_LEVELS, bins: int = BINS
) -> DataFrame:
    """Classes of rows that are not told apart: class, rows, values, `<column>_from` and `<column>_to`.

    `quasi` are columns of numbers, `values` counts the distinct non-null values of `sensitive`. Every
    class has at least `k` rows, unless the table has fewer. Classes are cut in two at most `levels`
    times; those cut from class c are 2c and 2c + 1. Nulls lie below all values; limits are null where a
    class holds nothing else. An empty table has no classes. Runs jobs while called.
    """
    limits = [
        f(f"__{e}{i}").alias(f"{c}_{e}")
        for i, c in enumerate(quasi)
        for e, f in (("from", F.min), ("to", F.max))
    ]
    values = F.count_distinct("__sensitive").alias("values")
    cells, places = _classed(df, quasi, sensitive, k, levels, bins)
    cells = join_parent(cells, places, [f"__c{i}" for i in range(len(quasi))])
    return cells.groupBy("class").agg(F.sum("n").alias("rows"), values, *limits)


def generalize(
    df: DataFrame, quasi: Sequence[str], sensitive: str, k: int, levels: int = MAX_LEVELS, bins: int = BINS
) -> DataFrame:
    """All rows, each column of `quasi` replaced by the limits `<column>_from` and `<column>_to` of its class.

    See `anonymous_classes`. Other columns stay; identifiers among them must be removed or replaced first.
    """
    names = [f"__c{i}" for i in range(len(quasi))]
    cells, places = _classed(df, quasi, sensitive, k, levels, bins)
    limits = [(f, f"__{e}{i}", f"{c}_{e}") for i, c in enumerate(quasi) for e, f in (("from", F.min), ("to", F.max))]
    cells = join_parent(cells, places, names)
    classes = cells.groupBy("class").agg(*[f(a).alias(b) for f, a, b in limits])
    places = stored(places.join(classes, "class").drop("class"), "classes")
    coded = df.select("*", *_codes(df, quasi, bins))
    others = [c for c in df.columns if c not in quasi]
    return join_parent(coded, places, names).select(*others, *[b for _, _, b in limits])


def anonymity(df: DataFrame, classes: Sequence[str], sensitive: str) -> DataFrame:
    """How well rows hide: one row (classes, rows, k, l).

    Rows with equal values in the columns `classes` are a class; k is the size of the smallest and l the least
    number of distinct non-null values of `sensitive` in one. Both are null for an empty table.
    """
    per_value = df.groupBy(*classes, F.col(sensitive).alias("__sensitive")).agg(F.count(F.lit(1)).alias("n"))
    per_class = per_value.groupBy(*classes).agg(F.sum("n").alias("n"), F.count("__sensitive").alias("values"))
    return per_class.agg(
        F.count(F.lit(1)).alias("classes"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.min("n").alias("k"),
        F.min("values").alias("l"),
    )

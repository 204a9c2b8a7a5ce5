"""Frequent subsequences of timelines, mined by growing prefixes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seektrail.plans.hot import stored


def frequent_sequences(
    rows: DataFrame, sequence: str, order: list[str], item: Column, share: float, longest: int
) -> DataFrame:
    """Items that follow each other, not necessarily at once, in at least `share` of all sequences.

    Returns pattern (the items in order), length and support (sequences that hold the pattern),
    for patterns of up to `longest` items. Rows of one `sequence` are ordered by the columns
    `order`, equal ones follow none of each other. Rows without a sequence, an item or any of
    `order` are left out, and a sequence without rows is not counted. No rows give no patterns.

    A pattern that is frequent is kept as one pointer per sequence, the earliest place where the
    pattern can end. The next items of a pattern are those after its pointers, so each round is a
    join of pointers with the rows of their sequence: its work is at most the patterns times the
    rows, no two rows of a sequence are paired, and Spark can split a sequence with very many
    rows. Pointers of a round are written to the shared folder. Runs jobs while it is called.
    """
    if not 0 < share <= 1 or longest < 1:
        raise ValueError("share is above 0 and at most 1, longest at least 1")
    place = F.struct(*order)
    rows = rows.select(F.col(sequence).alias("seq"), place.alias("place"), item.alias("item"))
    known = ["seq", "item", *[f"place.{c}" for c in order]]
    rows = rows.filter(" and ".join(f"{c} is not null" for c in known))
    total = rows.agg(F.count_distinct("seq")).first()[0]
    support = max(1, math.ceil(share * total - 1e-9))
    pointers = rows.groupBy("seq", "item").agg(F.min("place").alias("at"))
    pointers = stored(pointers.select("seq", F.array("item").alias("pattern"), "at"), "pointers")
    frequent = _frequent(pointers, support)
    found = [frequent.withColumn("length", F.lit(1))]
    # Items that are not frequent are in no frequent pattern.
    items = frequent.select(F.col("pattern")[0].alias("item"))
    rows = stored(rows.join(items, "item", "left_semi"), "rows") if longest > 1 else rows
    for length in range(2, longest + 1):
        kept = pointers.join(frequent.select("pattern"), "pattern", "left_semi")
        grown = (
            kept.join(rows.hint("merge"), "seq")
            .filter(F.col("place") > F.col("at"))
            .groupBy("seq", "pattern", "item")
            .agg(F.min("place").alias("at"))
        )
        grown = grown.select("seq", F.array_append("pattern", F.col("item")).alias("pattern"), "at")
        pointers = stored(grown, "pointers")
        frequent = _frequent(pointers, support)
        found.append(frequent.withColumn("length", F.lit(length)))
        if frequent.isEmpty():
            break
    patterns = found[0]
    for more in found[1:]:
        patterns = patterns.unionByName(more)
    return patterns.select("pattern", "length", "support")


def _frequent(pointers: DataFrame, support: int) -> DataFrame:
    counts = pointers.groupBy("pattern").agg(F.count(F.lit(1)).alias("support"))
    return stored(counts.filter(F.col("support") >= support), "frequent")

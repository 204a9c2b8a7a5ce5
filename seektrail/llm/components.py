"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seektrail.plans.hot import stored


def _with_smallest(links: DataFrame) -> DataFrame:
    """Links (u, v) with the smallest of u and its v. Aggregated first, so a hub is no hot task."""
    smallest = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return links.join(smallest, "u")


def components(edges: DataFrame) -> DataFrame:
    """The ids in edges (a, b) with `component`, the smallest id that each can reach.

    Alternates large stars (a node's larger neighbours are linked to its smallest one) and small
    stars (the same for smaller neighbours) until the edges no longer change; the number of
    rounds grows with the logarithm of the graph. Each round is written to the shared folder. Runs
    jobs while it is called; one small row per round comes to the driver. No edges give no rows.
    """
    a, b = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = stored(edges.filter("a <> b").select(a, b).distinct(), "edges")
    state = None
    while True:
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        now = tuple(edges.agg(F.count(F.lit(1)), total).first())
        if now == state or not now[0]:
            break
        state = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            _with_smallest(both)
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        small = _with_smallest(large)
        edges = stored(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct(),
            "edges",
        )
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)

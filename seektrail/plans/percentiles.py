"""Exact percentiles without bringing a group's values together in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seektrail.plans.hot import null_safe

# Width of a bin: no bin has more distinct whole numbers than this.
BIN = 1_000_000


def exact_percentiles(
    df: DataFrame, value: str, percentiles: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Interpolated percentiles of a whole-number column: columns by, p, rows, value.

    Values are counted, and the counts summed into bins. Running sums over the bins tell in
    which bin each wanted rank falls; running sums over the values of just those bins tell the
    value. So a window holds at most max(range / BIN, BIN) rows whatever the number of rows.
    """
    by = list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bin", F.floor(F.col("v") / BIN))
    )
    bins = counts.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    running = (Window.unboundedPreceding, 0)
    over_bins = Window.partitionBy(*by).orderBy("bin").rowsBetween(*running)
    ranks = F.array(
        *[
            F.struct(p.alias("p"), end(p * (F.col("rows") - 1)).alias("rank"))
            for p in (F.lit(float(p)) for p in percentiles)
            for end in (F.floor, F.ceil)
        ]
    )
    wanted = (
        bins.withColumn("before", F.sum("n").over(over_bins) - F.col("n"))
        .withColumn("rows", F.sum("n").over(Window.partitionBy(*by)))
        .withColumn("ranks", F.filter(F.array_distinct(ranks), _falls_here))
        .filter(F.size("ranks") > 0)
        .select(
            *[F.col(c).alias(f"wanted_{c}") for c in (*by, "bin")], "before", "rows", "ranks"
        )
    )
    if not by:
        # At most two rows per percentile.
        wanted = F.broadcast(wanted)
    same_bin = null_safe([(c, f"wanted_{c}") for c in (*by, "bin")])
    over_values = Window.partitionBy(*by, "bin").orderBy("v").rowsBetween(*running)
    found = (
        counts.join(wanted, same_bin)
        .withColumn("before", F.col("before") + F.sum("n").over(over_values) - F.col("n"))
        .select(*by, "v", "rows", F.explode(F.filter("ranks", _falls_here)).alias("at"))
    )
    low, high = F.min("v"), F.max("v")
    place = F.col("at.p") * (F.col("rows") - 1)
    return found.groupBy(*by, F.col("at.p").alias("p"), "rows").agg(
        (low + (high - low) * F.any_value(place - F.floor(place))).alias("value")
    )


def _falls_here(at):
    return (at["rank"] >= F.col("before")) & (at["rank"] < F.col("before") + F.col("n"))

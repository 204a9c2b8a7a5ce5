"""Column expressions for rates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros_between(start: str, end: str) -> Column:
    """Microseconds from one timestamp column to another; no time zone comes into it."""
    seconds = (F.col(end) - F.col(start)).cast("interval second").cast("decimal(18,6)")
    return (seconds * 1_000_000).cast("bigint")


def pooled_z(n_a: Column, hits_a: Column, n_b: Column, hits_b: Column) -> Column:
    """z statistic of the difference of two proportions under a pooled rate."""
    pooled = F.try_divide(hits_a + hits_b, n_a + n_b)
    weight = F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b)
    error = F.sqrt(pooled * (1 - pooled) * weight)
    return F.try_divide(F.try_divide(hits_a, n_a) - F.try_divide(hits_b, n_b), error)

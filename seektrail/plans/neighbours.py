"""The nearest earlier or later event of the same user, also for users with very many events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seektrail.plans.hot import timeline_keys

BEFORE = (Window.unboundedPreceding, -1)


def timeline(log: DataFrame, ahead: bool = False) -> WindowSpec:
    """The events of one user, or of one slice of a user, in (ts, event_id) order.

    A row copied from another slice comes first, also among copies of the same event.
    """
    order = [F.desc(c) if ahead else F.asc(c) for c in ("ts", "event_id")]
    copied = [F.desc("copied")] if "copied" in log.columns else []
    return Window.partitionBy(*timeline_keys(log)).orderBy(*order, *copied)


def neighbour(
    log: DataFrame,
    name: str,
    fields: Sequence[str],
    where: Column | None = None,
    ahead: bool = False,
) -> DataFrame:
    """Add struct `name`: `fields` of the nearest earlier row (later if `ahead`) with `where`.

    `log` comes from `spread_users`. Rows without a user have no neighbours and are not shuffled:
    they are strangers to each other. Looking ahead is looking back in descending order: a frame
    that ends at the last row would be evaluated anew for each row.
    """
    anonymous, known = log.filter("user_id is null"), log.filter("user_id is not null")
    linked = link(known, name, fields, where, ahead)
    nothing = F.lit(None).cast(linked.schema[name].dataType)
    return linked.unionByName(anonymous.withColumn(name, nothing))


def link(
    log: DataFrame,
    name: str,
    fields: Sequence[str],
    where: Column | None = None,
    ahead: bool = False,
) -> DataFrame:
    """`neighbour` for a log in which every row has a user."""
    sliced = "slice" in log.columns
    rows = _with_row_before_slice(log, where, ahead) if sliced else log
    spec = timeline(rows, ahead)
    if where is None:
        # Field by field, so that the shuffle does not carry a second copy of them.
        previous = F.struct(*[F.lag(f).over(spec).alias(f) for f in fields])
        nearest = F.when(F.lag(F.lit(True)).over(spec), previous)
    else:
        hit = F.when(where, F.struct(*fields))
        nearest = F.last(hit, ignorenulls=True).over(spec.rowsBetween(*BEFORE))
    linked = rows.withColumn(name, nearest)
    if sliced:
        linked = linked.filter(~F.col("copied")).drop("copied")
    return linked


def _with_row_before_slice(log: DataFrame, where: Column | None, ahead: bool) -> DataFrame:
    """Each slice with a copy, marked `copied`, of the nearest row with `where` in earlier ones.

    That row is found by a partial aggregation and a window over the slices of the user.
    """
    position = F.struct("ts", "event_id")
    nearest = F.min_by if ahead else F.max_by
    slices = Window.partitionBy("user_id").orderBy(F.desc("slice") if ahead else F.asc("slice"))
    columns = [c for c in log.columns if c not in timeline_keys(log)]
    copies = (
        log.filter("slice > 0")
        .groupBy("user_id", "slice")
        .agg(
            nearest(
                F.struct(*columns), position if where is None else F.when(where, position)
            ).alias("row")
        )
        .withColumn("row", F.last("row", ignorenulls=True).over(slices.rowsBetween(*BEFORE)))
        .filter(F.col("row").isNotNull())
        .select("user_id", "slice", "row.*", F.lit(True).alias("copied"))
    )
    return log.withColumn("copied", F.lit(False)).unionByName(copies)

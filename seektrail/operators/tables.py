"""Analysis tables: roll-ups, trends, waiting times and group comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seektrail.functions.rates import micros_between, pooled_z
from seektrail.operators.behaviour import detail_entry
from seektrail.plans.hot import null_safe
from seektrail.plans.percentiles import exact_percentiles


def behaviour_rollup(
    log: DataFrame, dims: Sequence[str], cube: bool = False, approx: bool = False
) -> DataFrame:
    """Events and distinct users per rollup (or cube) of `dims`, with `level` from grouping_id.

    Events are first counted per dims and user, so that the copies a rollup makes are of those
    few rows. `approx=True` estimates the users and needs no shuffle on the user.
    """
    dims = list(dims)
    if approx:
        rows, events, users = log, F.count(F.lit(1)), F.approx_count_distinct("user_id")
    else:
        rows = log.groupBy(*dims, "user_id").agg(F.count(F.lit(1)).alias("n"))
        events, users = F.sum("n"), F.count_distinct("user_id")
    grouped = rows.cube(*dims) if cube else rows.rollup(*dims)
    return grouped.agg(
        F.grouping_id().alias("level"), events.alias("events"), users.alias("users")
    )


def daily_trend(
    log: DataFrame, measure: Column, days: int, by: Sequence[str] = ()
) -> DataFrame:
    """A measure per day and its sum over the last `days` calendar days, days without rows included.

    `measure` is an aggregate. The window runs over one row per day (and `by` group).
    """
    day_number = F.unix_date("day")
    window = Window.partitionBy(*by).orderBy(day_number).rangeBetween(-days + 1, 0)
    daily = log.groupBy(*by, F.to_date("ts").alias("day")).agg(measure.alias("value"))
    return daily.withColumn("rolling", F.sum("value").over(window))


def rolling_users(log: DataFrame, days: int, by: Sequence[str] = ()) -> DataFrame:
    """Distinct users of the `days` days up to each day, exact.

    Returns `by`, day and users for each day on which a group of `by` has an event of a user. A
    user counts from an active day until `days` - 1 later or the next active one: each active day
    is one coming and one going, which are summed up, so nothing is copied to `days` days. Events
    without a user or a time are left out.
    """
    active = log.filter("user_id is not null and ts is not null").select(*by, F.to_date("ts").alias("day"), "user_id")
    active = active.distinct()
    # A user has at most a row per day and group.
    spec = Window.partitionBy(*by, "user_id").orderBy("day")
    until = F.least(F.date_add("day", days), F.lead("day").over(spec))
    change = F.array(
        F.struct("day", F.lit(1).alias("change"), F.lit(1).alias("active")),
        F.struct(F.col("until").alias("day"), F.lit(-1).alias("change"), F.lit(0).alias("active")),
    )
    changes = active.withColumn("until", until).select(*by, F.inline(change))
    changes = changes.groupBy(*by, "day").agg(F.sum("change").alias("change"), F.sum("active").alias("active"))
    # One row per group and day.
    so_far = Window.partitionBy(*by).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    users = changes.withColumn("users", F.sum("change").over(so_far)).filter("active > 0")
    return users.select(*by, "day", "users")


def user_sketches(log: DataFrame, by: Sequence[str] = (), log_size: int = 12) -> DataFrame:
    """Per day and group of `by` a sketch of its users, to be stored and merged by `users_of`.

    The sketch is Spark's HyperLogLog of text with 2^log_size registers; its error is about
    1.04 / 2^(log_size / 2), so 1.6 % as set. Events without a user or a time are left out.
    """
    known = log.filter("user_id is not null and ts is not null").withColumn("day", F.to_date("ts"))
    user = F.col("user_id").cast("string")
    return known.groupBy(*by, "day").agg(F.hll_sketch_agg(user, F.lit(log_size)).alias("sketch"))


def users_of(sketches: DataFrame, days: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Estimated distinct users of the `days` days up to each day, from the sketches of the days.

    `by` are those columns of the sketches that are kept apart; the others are merged, so one
    table of sketches serves every level of a cube. Only sketches are read, and one is copied to
    the `days` days that it counts for.
    """
    ahead = F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1))).alias("day")
    present = sketches.select(*by, "day").distinct()
    spread = sketches.select(*by, ahead, "sketch")
    merged = spread.groupBy(*by, "day").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))
    condition = null_safe([(merged[c], present[c]) for c in (*by, "day")])
    return merged.join(present, condition, "left_semi").select(*by, "day", "users")


def time_to_detail(
    log: DataFrame, within: timedelta, percentiles: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact percentiles, in seconds, of the time from a search to its detail view.

    `by` names columns of `detail_entry`.
    """
    entered = (
        detail_entry(log, within)
        .filter("entered")
        .select(*by, micros_between("ts", "detail_ts").alias("micros"))
    )
    return exact_percentiles(entered, "micros", percentiles, by).select(
        *by, "p", F.col("rows").alias("entries"), (F.col("value") / 1_000_000).alias("seconds")
    )


def compare_groups(df: DataFrame, group: Column, flag: Column, a: object, b: object) -> DataFrame:
    """Share of rows with `flag` in group `a` and in group `b`, their difference and z statistic.

    One row. z is that of a pooled two-proportion test: null if a group is empty or the pooled
    rate is 0 or 1.
    """
    known = flag.isNotNull()
    counts = df.agg(
        F.count_if(known & (group == a)).alias("n_a"),
        F.count_if(flag & (group == a)).alias("hits_a"),
        F.count_if(known & (group == b)).alias("n_b"),
        F.count_if(flag & (group == b)).alias("hits_b"),
    )
    rates = counts.withColumns(
        {
            "rate_a": F.try_divide("hits_a", "n_a"),
            "rate_b": F.try_divide("hits_b", "n_b"),
        }
    )
    return rates.withColumns(
        {
            "difference": F.col("rate_a") - F.col("rate_b"),
            "z": pooled_z(*map(F.col, ("n_a", "hits_a", "n_b", "hits_b"))),
        }
    )


# A Poisson(1) count is how many of these a uniform 32-bit number reaches: the shares of counts of
# up to 0, 1, 2, ... times 2^32, rounded down (fixed values of the distribution).
_POISSON = [
    int(2**32 * math.exp(-1) * sum(1 / math.factorial(k) for k in range(n + 1))) for n in range(12)
]


def poisson_replicates(df: DataFrame, cluster: str, sums: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """`sums` over all rows in each of `replicates` Poisson bootstrap samples of whole clusters.

    `df` has one row per cluster. Its weight in a replicate follows from an md5 of seed, cluster and
    replicate, four replicates to an md5, so reruns and other engines agree. All replicates are
    sums of one aggregation, of which a task hands on one row each.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(cluster).cast("string"), "draw"))
    draws = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // 4) - 1))))
    draws = draws.withColumn("digest", digest).withColumn("word", F.explode(F.array(*map(F.lit, range(4)))))
    uniform = F.conv(F.substring(F.col("digest"), 1 + 8 * F.col("word"), F.lit(8)), 16, 10).cast("bigint")
    draws = draws.withColumn("uniform", uniform).withColumn("replicate", 4 * F.col("draw") + F.col("word"))
    weight = F.lit(0)
    for limit in _POISSON:
        weight = weight + (F.col("uniform") >= limit).cast("int")
    drawn = draws.filter(F.col("replicate") < replicates).withColumn("weight", weight)
    return drawn.groupBy("replicate").agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in sums])


def clustered_comparison(
    df: DataFrame,
    cluster: str,
    group: Column,
    flag: Column,
    a: object,
    b: object,
    replicates: int = 1_000,
    level: float = 0.95,
    seed: int = 1,
) -> DataFrame:
    """The difference between the shares of `flag` in groups `a` and `b`, with an interval and p value.

    One row: clusters, difference, low, high (the middle `level` of the replicates' differences),
    p_value (twice the smaller share of replicates on one side of no difference, at most 1) and
    replicates (those in which both groups have rows). Rows of one cluster, such as the searches of
    a user, need not be independent: whole clusters are drawn. Rows without a cluster or a flag are
    left out. Without rows in both groups all but the counts is null.
    """
    known = df.withColumns({"__c": F.col(cluster), "__g": group, "__f": flag})
    known = known.filter("__c is not null and __f is not null")
    counted = {
        "n_a": F.count_if(F.col("__g") == a),
        "hits_a": F.count_if(F.col("__f") & (F.col("__g") == a)),
        "n_b": F.count_if(F.col("__g") == b),
        "hits_b": F.count_if(F.col("__f") & (F.col("__g") == b)),
    }
    each = known.groupBy("__c").agg(*[c.alias(name) for name, c in counted.items()])
    each = each.filter("n_a + n_b > 0")
    difference = F.try_divide("hits_a", "n_a") - F.try_divide("hits_b", "n_b")
    drawn = poisson_replicates(each, "__c", [*counted], replicates, seed)
    drawn = drawn.select(difference.alias("d")).filter("d is not null")
    whole = each.agg(F.count(F.lit(1)).alias("clusters"), *[F.sum(c).alias(c) for c in counted])
    whole = whole.select("clusters", difference.alias("difference"))
    tail = (1 - level) / 2
    side = F.least(F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double")))
    # One row per replicate, and one of the whole.
    return drawn.unionByName(whole, allowMissingColumns=True).agg(
        F.max("clusters").alias("clusters"),
        F.max("difference").alias("difference"),
        F.percentile("d", tail).alias("low"),
        F.percentile("d", 1 - tail).alias("high"),
        F.when(side.isNotNull(), F.least(2 * side, F.lit(1.0))).alias("p_value"),
        F.count("d").alias("replicates"),
    )

"""Laying out work so that keys holding a large share of the rows do not end up in one task.

The hot keys found here only decide how rows are laid out. Every result is the same whichever
keys are called hot, so finding them on a sample is enough.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows of one key that a single task is trusted with; `seektrail.hotRows` overrides it.
HOT_ROWS = 2_000_000
# Only so many keys are split, the largest first. Any key left out holds under 1/MAX_HOT_KEYS
# of the rows, and tables of hot keys stay small enough to broadcast.
MAX_HOT_KEYS = 10_000
# A key with HOT_ROWS rows is expected to be seen this often in the sample.
SAMPLE_HITS = 1_000


def hot_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("seektrail.hotRows", str(HOT_ROWS)))


# What was found, so that several operators on one log look for its hot users once. Should the
# data have changed since, only the layout of the work is no longer the best.
_found: dict[tuple, list[Row]] = {}


def forget() -> None:
    """Look for hot keys anew from now on."""
    _found.clear()


def hot_keys(df: DataFrame, keys: Sequence[str]) -> list[Row]:
    """The keys (null included) with over `seektrail.hotRows` rows, and their estimated `rows`.

    Runs one job that reads the key columns only and counts a sample of them.
    """
    limit = hot_rows(df.sparkSession)
    fraction = min(1.0, SAMPLE_HITS / limit)
    columns = df.select(*keys)
    known = (
        df.sparkSession.sparkContext.applicationId,
        columns.semanticHash(),
        columns.schema.simpleString(),
        limit,
    )
    if known not in _found:
        sample = columns if fraction == 1 else columns.sample(fraction, seed=7)
        _found[known] = (
            sample.groupBy(*keys)
            .agg((F.count(F.lit(1)) / fraction).cast("bigint").alias("rows"))
            .filter(F.col("rows") > limit)
            .orderBy(F.desc("rows"))
            .limit(MAX_HOT_KEYS)
            .collect()
        )
    return _found[known]


def hot_table(df: DataFrame, keys: Sequence[str], hot: list[Row]) -> DataFrame:
    """Hot keys as columns `hot_<key>`. At most MAX_HOT_KEYS rows, marked for broadcast."""
    schema = T.StructType([T.StructField(f"hot_{k}", df.schema[k].dataType) for k in keys])
    rows = [tuple(row[k] for k in keys) for row in hot]
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def null_safe(pairs: Sequence[tuple[str | Column, str | Column]]) -> Column:
    """Join condition in which null equals null."""
    columns = [(F.col(a) if isinstance(a, str) else a, b) for a, b in pairs]
    return reduce(
        lambda x, y: x & y,
        [a.eqNullSafe(F.col(b) if isinstance(b, str) else b) for a, b in columns],
    )


def join_parent(
    child: DataFrame,
    parent: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join many child rows to the at most one parent row of their key.

    `how` is inner, left, left_semi or left_anti. Child rows of a hot key, null included, stay where
    they are, however the child is laid out: the parent rows of hot keys, at most MAX_HOT_KEYS, are
    sent to them. All other rows are shuffled by key. Hot keys are looked for in `counted`, a table
    that holds the same keys but is cheaper to compute than `child`, if there is one.
    """
    keys = list(keys)
    hot = hot_keys(child if counted is None else counted, keys)
    if not hot:
        return child.join(parent, keys, how)
    table = hot_table(child, keys, hot)
    is_hot = null_safe([(k, f"hot_{k}") for k in keys])
    own = parent.join(table, is_hot, "left_semi")
    if how in ("left_semi", "left_anti"):
        own = own.select(*keys).distinct()
    own = F.broadcast(own)
    stay = child.join(table, is_hot, "left_semi").join(own, keys, how)
    return child.join(table, is_hot, "left_anti").join(parent, keys, how).unionByName(stay)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by `spark.checkpoint.dir`.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written to the shared folder and read back, so that their lineage ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}_{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_users(log: DataFrame) -> DataFrame:
    """Add column `slice` if the log has hot users; leave it as it is otherwise.

    Timelines of hot users are cut by range over (user, time, event) into slices of about equal
    row count, whatever the spread of the events over time; copies of one event are told apart by
    the task that read them. Slices of a user rise with time. All other users have slice 0. The
    cut is written to the shared folder because its limits come
    from a sample: all readers must see the same one.

    Operators call this themselves. Calling it before several operators cuts only once.
    """
    if "slice" in log.columns:
        return log
    spark = log.sparkSession
    hot = [row for row in hot_keys(log, ["user_id"]) if row["user_id"] is not None]
    if not hot:
        return log
    table = hot_table(log, ["user_id"], hot)
    is_hot = null_safe([("user_id", "hot_user_id")])
    slices = max(2, 2 * sum(row["rows"] for row in hot) // hot_rows(spark))
    cut = stored(
        log.join(table, is_hot, "left_semi")
        .withColumn("task", F.spark_partition_id())
        .repartitionByRange(slices, "user_id", "ts", "event_id", "task")
        .drop("task")
        .withColumn("slice", F.spark_partition_id() + F.lit(1)),
        "slices",
    )
    rest = log.join(table, is_hot, "left_anti").withColumn("slice", F.lit(0))
    return rest.unionByName(cut)


def timeline_keys(log: DataFrame) -> list[str]:
    """Columns that together name one stretch of one user's timeline."""
    return ["user_id", "slice"] if "slice" in log.columns else ["user_id"]

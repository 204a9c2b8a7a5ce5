"""Versions of a table stored in buckets with a tree of their hashes, to find what differs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from seektrail.functions.hashing import NULL_MARK, SEPARATOR, as_text
from seektrail.operators.snapshots import snapshot_diff
from seektrail.sources.snapshots import read_snapshot, write_snapshot

TREE_SCHEMA = (
    "level int, node bigint, rows bigint, word_1 bigint, word_2 bigint, levels int, fanout int"
)
_HASHES = ["rows", "word_1", "word_2"]


def write_hashed(
    df: DataFrame,
    root: str,
    name: str,
    version: str,
    key: Sequence[str],
    levels: int = 2,
    fanout: int = 16,
) -> None:
    """Write a version of a table in `fanout ** levels` buckets of its key, and the tree of their hashes.

    Rows go to `<root>/<name>/snapshot=<version>/bucket=<n>`, the tree to
    `<root>/<name>.hashes/snapshot=<version>`: per node its number of rows and the sums of two words of their
    md5, names and types of the columns included. Leaves are the buckets that have rows; a node's hash is
    the sum of its children's. The tree is emptied first and written last, from the rows as stored,
    so a version that broke off has none and cannot be compared. Choose the buckets so that one, of
    about 1 / buckets of the rows, is worth a task.
    """
    if levels < 1 or fanout < 2:
        raise ValueError("a tree has at least one level and two children per node")
    if "bucket" in df.columns:
        raise ValueError("the name of the column of buckets is taken: bucket")
    spark, tree = df.sparkSession, f"{name}.hashes"
    write_snapshot(spark.createDataFrame([], TREE_SCHEMA), root, tree, version)
    buckets = fanout**levels
    bucket = F.pmod(_word(_digest(df, key), 1), F.lit(buckets)).alias("bucket")
    dealt = df.select(*df.columns, bucket).repartition("bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}/snapshot={version}")
    rows = _rows(spark, root, name, df, version)
    digest = _digest(rows, sorted(df.columns), names=True)
    leaves = rows.select("bucket", _word(digest, 1).alias("word_1"), _word(digest, 9).alias("word_2"))
    leaves = leaves.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("word_1").alias("word_1"), F.sum("word_2").alias("word_2")
    )
    steps = [
        F.struct(F.lit(k).alias("level"), F.expr(f"bucket div {fanout ** (levels - k)}").alias("node"))
        for k in range(1, levels + 1)
    ]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _HASHES]
    shape = {"levels": F.lit(levels), "fanout": F.lit(fanout)}
    inner = leaves.select(F.inline(F.array(*steps)), *_HASHES).groupBy("level", "node").agg(*sums)
    top = leaves.agg(*sums).withColumns({"level": F.lit(0), "node": F.lit(0).cast("bigint")})
    # One row per node, of which there are fewer than twice the buckets.
    write_snapshot(top.unionByName(inner).withColumns(shape).coalesce(1), root, tree, version)


def changed_rows(
    spark: SparkSession, root: str, name: str, schema: str, key: Sequence[str], old: str, new: str
) -> DataFrame:
    """The rows of `snapshot_diff` between two versions of `write_hashed` that are not the same.

    The trees are compared from the top: only children of nodes that differ are looked at, and only
    buckets that differ are read, as a filter on the folders. What comes back while this is called is at most the numbers of
    the buckets, whose count was chosen when the versions were written. `schema` is that of
    the table and holds for both versions. Trees of different shapes are an error.
    """
    nodes = unequal_buckets(spark, root, name, old, new)
    sides = [
        read_snapshot(spark, root, name, f"{schema}, bucket bigint", version)
        .filter(F.col("bucket").isin(nodes))
        .drop("bucket", "snapshot")
        for version in (old, new)
    ]
    return snapshot_diff(*sides, key).filter(F.col("state") != "same")


def unequal_buckets(spark: SparkSession, root: str, name: str, old: str, new: str) -> list[int]:
    """The buckets in which two versions differ, in order."""
    trees = [read_snapshot(spark, root, f"{name}.hashes", TREE_SCHEMA, v) for v in (old, new)]
    shapes = [tree.filter("level = 0").select("levels", "fanout").collect() for tree in trees]
    if not all(shapes):
        raise ValueError(f"{name} has a version without hashes among {old}, {new}")
    if shapes[0] != shapes[1]:
        raise ValueError(f"versions {old} and {new} of {name} have trees of different shapes")
    levels, fanout = shapes[0][0]
    nodes = [0]
    for level in range(levels + 1):
        if level:
            nodes = [node * fanout + k for node in nodes for k in range(fanout)]
        wanted = (F.col("level") == level) & F.col("node").isin(nodes)
        sides = [tree.filter(wanted).select("node", F.struct(*_HASHES).alias(f"of_{k}")) for k, tree in enumerate(trees)]
        unequal = sides[0].join(sides[1], "node", "full").filter(~F.col("of_0").eqNullSafe(F.col("of_1")))
        nodes = sorted(row["node"] for row in unequal.select("node").collect())
    return nodes


def _rows(spark: SparkSession, root: str, name: str, df: DataFrame, version: str) -> DataFrame:
    schema = StructType([*df.schema.fields, StructField("bucket", LongType())])
    return spark.read.schema(schema).parquet(f"{root}/{name}/snapshot={version}")


def _digest(df: DataFrame, columns: Sequence[str], names: bool = False) -> Column:
    kinds = dict(df.dtypes)
    text = [F.coalesce(as_text(c, kinds[c]), F.lit(NULL_MARK)) for c in columns]
    if names:
        text += [F.lit(f"{c} {kinds[c]}") for c in columns]
    return F.md5(F.concat_ws(SEPARATOR, *text))


def _word(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")

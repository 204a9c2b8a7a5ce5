"""Differences found through hash trees against the plain comparison of whole versions."""

import re
from pathlib import Path

import pytest
from fixtures import multiset
from pyspark.sql import functions as F

from seektrail.operators.snapshots import snapshot_diff
from seektrail.sources.hash_trees import changed_rows, unequal_buckets, write_hashed
from seektrail.sources.snapshots import write_snapshot

SCHEMA = "k bigint, a string, b double"


@pytest.fixture(scope="module")
def old(spark):
    rows = spark.range(600).select(F.col("id").alias("k"), F.concat(F.lit("a"), F.col("id") % 7).alias("a"))
    rows = rows.withColumn("b", F.when(F.col("k") % 5 > 0, F.col("k") / 4))
    return rows.unionByName(spark.createDataFrame([(None, "none", 1.0)], SCHEMA))


def both(spark, root, old, new, **shape):
    write_hashed(old, root, "t", "v1", ["k"], **shape)
    write_hashed(new, root, "t", "v2", ["k"], **shape)
    return changed_rows(spark, root, "t", SCHEMA, ["k"], "v1", "v2")


def plain(old, new):
    return multiset(snapshot_diff(old, new, ["k"]).filter("state <> 'same'"))


@pytest.mark.parametrize("shape", [{}, {"levels": 1, "fanout": 2}, {"levels": 3, "fanout": 4}])
def test_same_rows_as_the_whole_comparison(spark, tmp_path, old, shape):
    new = old.filter("k is null or k <> 17").withColumn("b", F.when(F.expr("k = 41"), None).otherwise(F.col("b")))
    new = new.withColumn("a", F.when(F.col("k").isNull(), "other").otherwise(F.col("a")))
    new = new.unionByName(spark.createDataFrame([(1000, None, None)], SCHEMA))
    found = multiset(both(spark, str(tmp_path), old, new, **shape))
    assert found == plain(old, new) and len(found) == 4


def test_equal_buckets_are_not_read(spark, tmp_path, old):
    new = old.withColumn("a", F.when(F.expr("k in (3, 99)"), "new").otherwise(F.col("a")))
    expected = plain(old, new)
    root = str(tmp_path)
    changes = both(spark, root, old, new)
    unequal = unequal_buckets(spark, root, "t", "v1", "v2")
    assert 1 <= len(unequal) <= 2
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#", plan)
    spoiled = 0
    for file in Path(root, "t").rglob("*.parquet"):  # a bucket that is read would fail
        if int(file.parent.name.split("=")[1]) not in unequal:
            Path(file).write_bytes(b"not parquet")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
            spoiled += 1
    assert spoiled > 100
    again = changed_rows(spark, root, "t", SCHEMA, ["k"], "v1", "v2")
    assert multiset(again) == expected and len(expected) == 2


def test_equal_and_empty_versions(spark, tmp_path, old):
    assert both(spark, str(tmp_path / "x"), old, old.repartition(3).orderBy("a")).count() == 0
    nothing = old.limit(0)
    assert both(spark, str(tmp_path / "y"), nothing, nothing).count() == 0
    added = both(spark, str(tmp_path / "z"), nothing, old)
    assert {r["state"]: r["count"] for r in added.groupBy("state").count().collect()} == {"added": 601}


def test_values_that_change_places_are_seen(spark, tmp_path):
    one = spark.createDataFrame([(1, "x", 1.0), (2, "y", 1.0)], SCHEMA)
    two = spark.createDataFrame([(1, "y", 1.0), (2, "x", 1.0)], SCHEMA)
    found = both(spark, str(tmp_path), one, two, levels=1, fanout=2)
    assert {(r["k"], r["state"]) for r in found.collect()} == {(1, "changed"), (2, "changed")}


def test_versions_that_cannot_be_compared(spark, tmp_path, old):
    root = str(tmp_path)
    write_hashed(old, root, "t", "v1", ["k"])
    write_hashed(old, root, "t", "v2", ["k"], levels=1)
    with pytest.raises(ValueError, match="shapes"):
        unequal_buckets(spark, root, "t", "v1", "v2")
    tree = spark.read.parquet(f"{root}/t.hashes/snapshot=v1")
    write_snapshot(tree.limit(0), root, "t.hashes", "v3")  # as a run that broke off leaves it
    with pytest.raises(ValueError, match="without hashes"):
        unequal_buckets(spark, root, "t", "v1", "v3")
    with pytest.raises(ValueError):
        write_hashed(old.withColumn("bucket", F.lit(1)), root, "t", "v4", ["k"])

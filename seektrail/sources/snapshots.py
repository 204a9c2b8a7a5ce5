"""Dated versions of a table, kept side by side in Parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that are the same in a path as in a listing.
_VERSION = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def write_snapshot(df: DataFrame, root: str, name: str, version: str) -> None:
    """Write `df` as `<root>/<name>/snapshot=<version>`; other versions stay as they are.

    A version that is there is replaced, also by an empty table, which is a version like any other.
    """
    if not _VERSION.fullmatch(version):
        raise ValueError(f"a version has letters, digits, dots, dashes and underscores: {version!r}")
    df.write.mode("overwrite").parquet(f"{root}/{name}/snapshot={version}")


def _age(version: str) -> list[tuple[int, int, str]]:
    """Sorts numbers within names as numbers, so that v9 comes before v10."""
    parts = re.findall(r"[0-9]+|[^0-9]+", version)
    return [(0, int(p), "") if p[0].isascii() and p.isdigit() else (1, 0, p) for p in parts]


def versions(spark: SparkSession, root: str, name: str) -> list[str]:
    """The versions there are, oldest name first. Lists folders and reads no data."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    folders = [status.getPath().getName() for status in files.listStatus(path)]
    return sorted((f.split("=", 1)[1] for f in folders if f.startswith("snapshot=")), key=_age)


def read_snapshot(
    spark: SparkSession, root: str, name: str, schema: str, version: str | None = None
) -> DataFrame:
    """One version of a table, the newest by name if none is given; no other one is looked at.

    `schema` is that of the table without `snapshot`. A version that is not there is an error.
    """
    there = versions(spark, root, name)
    if not there or version not in (None, *there):
        raise ValueError(f"{name} has no version {version or ''}; there are {there}")
    version = version or there[-1]
    df = spark.read.schema(schema).parquet(f"{root}/{name}/snapshot={version}")
    return df.withColumn("snapshot", F.lit(version))

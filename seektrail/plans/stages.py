"""Analyses in ordered stages, each written out and readable on its own."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from datetime import date, timedelta
from functools import reduce
from hashlib import sha256
from types import CodeType, FunctionType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seektrail.functions.hashing import fingerprint

Stage = tuple[str, Callable[[Mapping[str, DataFrame]], DataFrame]]


def run_stages(
    spark: SparkSession,
    stages: Sequence[Stage],
    inputs: Mapping[str, DataFrame],
    out_dir: str,
    resume: bool = False,
) -> dict[str, DataFrame]:
    """Run the stages in order and return each one's result as read back from Parquet.

    A stage is a name and a function from the inputs and earlier results to a DataFrame; it is
    written to `<out_dir>/<number>_<name>`. Reading results back cuts their lineage.

    `<out_dir>/manifests/<number>_<name>` says what a result was made from: a hash of the inputs'
    fingerprints and of the code of this and all earlier stages, and the result's schema. It is
    emptied before a stage is written and filled when the stage is complete, so a run that breaks off
    anywhere leaves no result that passes for one of other inputs or code. With `resume`, results
    whose manifests are what this run would write are taken as they are, up to the first that is
    not; it and all after it are run.

    The code of a stage is that of its function, the functions in it, and the plain values it refers
    to. Functions that it calls from elsewhere are not looked into: rename the stage if they change.
    Inputs are read once to fingerprint them.
    """
    results: dict[str, DataFrame] = {}
    made_from = sorted(tuple(r) for r in stage_fingerprints(inputs).collect()) if inputs else []
    chain = _digest(made_from)
    for number, (name, build) in enumerate(stages, start=1):
        path, manifest = (f"{out_dir}/{part}{number:02d}_{name}" for part in ("", "manifests/"))
        chain = _digest((chain, name, code_of(build)))
        schema = _made(spark, manifest, chain) if resume and _complete(spark, path) else None
        if schema is None:
            resume = False
            result = build({**inputs, **results})
            schema = result.schema
            _record(spark, manifest, [])
            result.write.mode("overwrite").parquet(path)
            _record(spark, manifest, [(chain, schema.json())])
        results[name] = spark.read.schema(schema).parquet(path)
    return results


_MANIFEST = "made_from string, schema string"
_PLAIN = (str, bytes, int, float, bool, type(None), timedelta, date)


def _record(spark: SparkSession, path: str, rows: list[tuple[str, str]]) -> None:
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(path)


def _made(spark: SparkSession, path: str, chain: str) -> StructType | None:
    """The schema of a result whose manifest names `chain`; None if it does not."""
    if not _complete(spark, path):
        return None
    for row in spark.read.schema(_MANIFEST).parquet(path).collect():
        if row["made_from"] == chain:
            return StructType.fromJson(json.loads(row["schema"]))
    return None


def _digest(value: object) -> str:
    return sha256(repr(value).encode()).hexdigest()


def _plain(value: object) -> object:
    """The value if it cannot change and is plain or holds plain ones, else nothing."""
    if isinstance(value, (tuple, frozenset)):
        held = [_plain(x) for x in (sorted(value, key=repr) if isinstance(value, frozenset) else value)]
        return (type(value).__name__, held)
    return repr(value) if isinstance(value, _PLAIN) else None


def code_of(function: Callable) -> str:
    """A hash of a function's code and of the plain values that it refers to."""
    if not isinstance(function, FunctionType):
        return _digest(getattr(function, "__qualname__", type(function).__qualname__))

    def parts(code: CodeType) -> list:
        inner = [parts(c) if isinstance(c, CodeType) else _plain(c) for c in code.co_consts]
        return [code.co_code, code.co_names, code.co_varnames, code.co_freevars, inner]

    code = function.__code__
    outer = [_plain(function.__globals__.get(n)) for n in code.co_names]
    closed = [_plain(c.cell_contents) for c in function.__closure__ or ()]
    return _digest([parts(code), outer, closed, _plain(function.__defaults__ or ())])


def _complete(spark: SparkSession, path: str) -> bool:
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def stage_fingerprints(results: Mapping[str, DataFrame]) -> DataFrame:
    """One row (stage, rows, hash_1, hash_2) per stage, to compare runs with."""
    return reduce(
        DataFrame.unionByName,
        [fingerprint(df).withColumn("stage", F.lit(name)) for name, df in results.items()],
    ).select("stage", "rows", "hash_1", "hash_2")

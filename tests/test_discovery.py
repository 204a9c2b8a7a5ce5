"""Keys and dependencies against brute force over all sets of columns."""

from itertools import combinations

import numpy as np
import pytest

from seektrail.operators import discovery
from seektrail.operators.discovery import dependencies, minimal_keys

SCHEMA = "a int, b int, c string, d double, e int"
NAMES = ("a", "b", "c", "d", "e")


def classes(rows, columns):
    return len({tuple(r[NAMES.index(c)] for c in columns) for r in rows})


def plain_keys(rows, largest):
    sets = [s for n in range(largest + 1) for s in combinations(NAMES, n)]
    keys = [s for s in sets if rows and classes(rows, s) == len(rows)]
    return {s for s in keys if not any(set(k) < set(s) for k in keys)}


def plain_dependencies(rows, largest):
    sets = [s for n in range(largest + 1) for s in combinations(NAMES, n)]
    sets = [s for s in sets if rows and classes(rows, s) < len(rows)]
    held = {(s, c) for s in sets for c in NAMES if c not in s and classes(rows, s) == classes(rows, (*s, c))}
    return {(s, c) for s, c in held if not any(d == c and set(t) < set(s) for t, d in held)}


def found_keys(df, **options):
    rows = [tuple(r["columns"]) for r in minimal_keys(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def found_dependencies(df, **options):
    rows = [(tuple(r["columns"]), r["determines"]) for r in dependencies(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def table(kind, random):
    """Rows in which columns follow from others, are the same by other names, or are constant."""
    rows = []
    for k in range({"wide": 40, "keyed": 30, "equal": 60, "constant": 25}[kind]):
        a, b, e = (int(x) for x in random.integers(0, 5, 3))
        rows.append({
            "wide": (a, b, str((a + b) % 3), float(e), e % 2),
            "keyed": (k, b, f"x{b}", float(k), b // 2),
            "equal": (a, a * 10, None if b == 2 else str(b), b / 2, (a * b) % 4),
            "constant": (7, None, str(a), float(a), e),
        }[kind])
    return rows


@pytest.mark.parametrize("kind", ["wide", "keyed", "equal", "constant"])
@pytest.mark.parametrize("largest", [1, 4])
def test_all_sets_by_brute_force(spark, kind, largest):
    rows = table(kind, np.random.default_rng(3))
    df = spark.createDataFrame(rows, SCHEMA)
    assert found_keys(df, largest=largest) == plain_keys(rows, largest)
    assert found_dependencies(df, largest=largest) == plain_dependencies(rows, largest)


def test_random_tables(spark):
    random = np.random.default_rng(8)
    for size in (5, 14):
        rows = [tuple(int(x) for x in random.integers(0, 3, 5)) for _ in range(size)]
        rows = [(a, b, str(c), float(d), e) for a, b, c, d, e in rows]
        df = spark.createDataFrame(rows, SCHEMA)
        assert found_keys(df, largest=3) == plain_keys(rows, 3)
        assert found_dependencies(df, largest=3) == plain_dependencies(rows, 3)


def test_empty_table_single_row_and_repeated_rows(spark):
    row = (1, 2, "x", 0.5, None)
    df = spark.createDataFrame([row], SCHEMA)
    assert found_keys(df) == {()} and found_dependencies(df) == set()
    assert found_keys(df.limit(0)) == found_dependencies(df.limit(0)) == set()
    twice = spark.createDataFrame([row, row], SCHEMA)
    assert found_keys(twice) == set()
    assert found_dependencies(twice) == {((), c) for c in NAMES}


def test_nulls_zeros_and_separators(spark):
    rows = [(None, None, "x\x1fy", 0.0, 1), (None, 1, "x", -0.0, 1), (1, None, "\\N", 0.0, 2), (1, 1, None, 1.0, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found_keys(df, largest=2) == {("a", "b"), ("c",), ("b", "e")}
    assert (("a",), "e") in found_dependencies(df) and (("d",), "a") not in found_dependencies(df)
    assert found_keys(df, columns=["a", "d"], largest=2) == set()
    with pytest.raises(ValueError):
        minimal_keys(df, largest=0)


def stages(spark):
    gateway = spark.sparkContext._gateway
    store, none = spark._jsc.sc().statusStore(), gateway.jvm.java.util.ArrayList()
    found = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return [found.apply(k) for k in range(found.size())]


def shuffled(spark):
    """Rows written to shuffles so far."""
    return sum(stage.shuffleWriteRecords() for stage in stages(spark))


def test_sets_that_a_slice_refutes_are_not_shuffled_whole(spark, monkeypatch):
    monkeypatch.setattr(discovery, "SLICE_ROWS", 2_000, raising=False)
    rows = spark.range(40_000).selectExpr("id", *[f"pmod(xxhash64(id, {k}), 4000) AS c{k}" for k in range(6)])
    rows = rows.withColumn("c6", rows["c0"] % 7).localCheckpoint()
    before = shuffled(spark)
    assert found_keys(rows, largest=2) >= {("id",)}
    assert shuffled(spark) - before < 12 * rows.count()


def test_determined_columns_of_sets_that_a_slice_refutes(spark, monkeypatch):
    monkeypatch.setattr(discovery, "SLICE_ROWS", 2_000, raising=False)
    rows = spark.range(40_000).selectExpr(*[f"pmod(xxhash64(id, {k}), 2000) AS c{k}" for k in range(6)])
    rows = rows.withColumn("c6", rows["c0"] % 7).localCheckpoint()
    before = shuffled(spark)
    assert found_dependencies(rows, largest=1) == {(("c0",), "c6")}
    assert shuffled(spark) - before < 4 * rows.count()


def test_the_table_is_not_read_again_for_sets_that_a_slice_refutes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(discovery, "SLICE_ROWS", 500)
    # Two columns of few values, whose classes no slice of their own holds.
    values = enumerate([400] * 5 + [2] * 2)
    rows = spark.range(40_000).selectExpr(*[f"pmod(xxhash64(id, {k}), {n}) AS c{k}" for k, n in values])
    rows.withColumn("c7", rows["c0"] % 7).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    before = sum(stage.inputRecords() for stage in stages(spark))
    assert found_dependencies(rows, largest=2) == {(("c0",), "c7")}
    # 35 sets; slices of 8 columns hold about 4,000 rows.
    assert sum(stage.inputRecords() for stage in stages(spark)) - before < 10 * rows.count()


def test_slices_without_nulls_and_frequent_values_leave_results_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(discovery, "SLICE_ROWS", 10)
    rows = [(k if k % 10 == 0 else None, k % 2, None, 0.0, k // 3) for k in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found_keys(df, largest=4) == plain_keys(rows, 4)
    assert found_dependencies(df, largest=3) == plain_dependencies(rows, 3)
    # Nothing to slice by.
    rows = [(None, None, None, None, None)] * 40
    df = spark.createDataFrame(rows, SCHEMA)
    assert found_keys(df) == set()
    assert found_dependencies(df, largest=1) == plain_dependencies(rows, 1)


@pytest.mark.parametrize("kind", ["wide", "keyed", "equal", "constant"])
@pytest.mark.parametrize("size", [3, 12])
def test_slices_leave_results_as_they_are(spark, monkeypatch, kind, size):
    monkeypatch.setattr(discovery, "SLICE_ROWS", size, raising=False)
    rows = table(kind, np.random.default_rng(5))
    df = spark.createDataFrame(rows, SCHEMA)
    assert found_keys(df, largest=3) == plain_keys(rows, 3)
    assert found_dependencies(df, largest=2) == plain_dependencies(rows, 2)


def test_long_texts_maps_and_nulls_are_told_apart(spark):
    rows = [("x" * 40, {"a": 1}, None), ("x" * 39 + "y", {"a": 2}, "q"), ("x" * 40, {"a": 1}, "q"), ("", {}, None)]
    df = spark.createDataFrame(rows, "t string, m map<string,int>, n string")
    assert found_keys(df, largest=2) == {("t", "n"), ("m", "n")}
    assert found_dependencies(df, largest=1) == {(("t",), "m"), (("m",), "t")}

import pytest
from fixtures import multiset
from pyspark.sql import functions as F

from seektrail.functions.hashing import fingerprint
from seektrail.operators import quality, reduction
from seektrail.sources.model import FOREIGN_KEYS, SCHEMAS, ForeignKey
from seektrail.sources.tables import read_table

SF_DIR = "/root/testdata/sf0.01"


def test_profile(spark):
    rows = [("a", 1), ("é", 22), (None, 22), ("a", None)]
    df = spark.createDataFrame(rows, "s string, n int")
    expected = {("s", 4, 3, 2, 4, 2), ("n", 4, 3, 2, 5, 2)}
    assert {tuple(r) for r in reduction.column_profile(df).collect()} == expected
    assert {tuple(r) for r in reduction.column_profile(df, approx=True).collect()} == expected
    nulls = spark.createDataFrame([(None,)], "s string")
    assert reduction.column_profile(nulls).first() == ("s", 1, 0, 0, 0, None)


def test_profile_of_all_types(spark):
    events = read_table(spark, SF_DIR, "events")
    exact = {r["column"]: r for r in reduction.column_profile(events).collect()}
    assert set(exact) == set(events.columns)
    assert exact["event_id"]["distinct"] == exact["event_id"]["rows"] == 10_000


@pytest.mark.parametrize("fraction", [0.0, 0.05, 0.2, 1.0])
def test_subset_keeps_references(spark, fraction):
    names = ("region", "nation", "customer", "orders", "lineitem", "events", "part")
    tables = {n: read_table(spark, SF_DIR, n) for n in names}
    small = reduction.referential_subset(tables, FOREIGN_KEYS, "customer", "c_custkey", fraction)
    kept = small["customer"].count()
    assert abs(kept - 1500 * fraction) <= 60
    for fk in FOREIGN_KEYS:
        if fk.child in small and fk.parent in small:
            args = (fk.child_cols, small[fk.parent], fk.parent_cols)
            assert quality.orphans(small[fk.child], *args).count() == 0
    dropped = tables["customer"].join(small["customer"], "c_custkey", "left_anti")
    expected = tables["orders"].join(
        dropped, F.col("o_custkey") == F.col("c_custkey"), "left_anti"
    )
    assert small["orders"].count() == expected.count()
    assert small["part"].count() == tables["part"].count()
    if fraction == 1.0:
        for name in names:
            reduction.assert_same(small[name], tables[name])


def test_child_with_two_parents_keeps_both_references(spark):
    ids = spark.range(100)
    tables = {
        "root": ids.toDF("r"),
        "mid": ids.select(F.col("id").alias("m"), F.col("id").alias("r")),
        "leaf": ids.select(
            F.when(F.col("id") < 50, F.col("id")).alias("m"), (F.col("id") + 1).alias("r")
        ),
    }
    fks = [ForeignKey("leaf", (c,), p, (c,)) for c, p in (("r", "root"), ("m", "mid"))]
    fks.append(ForeignKey("mid", ("r",), "root", ("r",)))
    small = reduction.referential_subset(tables, fks, "root", "r", 0.5)
    kept = {r["r"] for r in small["root"].collect()}
    expected = {
        (i if i < 50 else None, i + 1) for i in range(100) if i + 1 in kept and (i >= 50 or i in kept)
    }
    assert {tuple(r) for r in small["leaf"].collect()} == expected
    # The first listed reference decides what a row belongs to: null there leaves it out.
    small = reduction.referential_subset(tables, [fks[1], fks[0], fks[2]], "root", "r", 0.5)
    assert {tuple(r) for r in small["leaf"].collect()} == {e for e in expected if e[0] is not None}


def test_root_nation_breaks_no_reference(spark):
    names = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    tables = {n: read_table(spark, "/root/testdata/sf0.001", n) for n in names}
    small = reduction.referential_subset(tables, FOREIGN_KEYS, "nation", "n_nationkey", 0.3)
    assert small["lineitem"].count() > 0
    assert {r["broken"] for r in reduction.broken_references(small, FOREIGN_KEYS).collect()} == {0}


def test_fine_fractions_rows_and_key_types(spark):
    tables = {"a": spark.range(400_000).toDF("x"), "b": spark.range(500).selectExpr("cast(id as double) y")}
    fks = [ForeignKey("b", ("y",), "a", ("x",))]
    small = reduction.referential_subset(tables, fks, "a", "x", 0.0001)
    assert 10 < small["a"].count() < 90
    half = reduction.referential_subset(tables, fks, "a", "x", 0.5)
    both = half["a"].filter("x < 500").count()
    assert half["b"].count() == both
    exact = reduction.referential_subset(tables, fks, "a", "x", root_rows=7)
    assert exact["a"].count() == 7
    for wrong in ({"fraction": -0.1}, {"fraction": 2}, {}, {"fraction": 0.5, "root_rows": 3}):
        with pytest.raises(ValueError):
            reduction.referential_subset(tables, fks, "a", "x", **wrong)


def test_unknown_ids_are_an_error(spark):
    words = {"s": spark.createDataFrame([("a", 1)], "value string, id bigint")}
    encoded = spark.createDataFrame([(1,), (2,)], "s bigint")
    with pytest.raises(Exception, match="not in the dictionary"):
        reduction.dictionary_decode(encoded, words).collect()


def test_orphans_are_not_kept_and_cycles_end(spark):
    tables = {"a": spark.range(10).toDF("x"), "b": spark.range(20).toDF("x")}
    fks = [ForeignKey("b", ("x",), "a", ("x",)), ForeignKey("a", ("x",), "b", ("x",))]
    small = reduction.referential_subset(tables, fks, "a", "x", 1.0)
    reduction.assert_same(small["b"], tables["a"])
    tables["c"] = tables["b"]
    fks = [ForeignKey(*p) for p in (("b", ("x",), "c", ("x",)), ("c", ("x",), "b", ("x",)))]
    fks.append(ForeignKey("b", ("x",), "a", ("x",)))
    with pytest.raises(ValueError, match="circle"):
        reduction.referential_subset(tables, fks, "a", "x", 1.0)


def test_drift(spark):
    full = spark.createDataFrame([(True,), (False,), (None,), (True,)], "hit boolean")
    metrics = {"hits": F.count_if("hit"), "share": F.avg(F.col("hit").cast("double"))}
    rows = reduction.sample_drift(full, full.filter("hit"), metrics).collect()
    assert {r["metric"]: (r["full"], r["subset"], r["difference"]) for r in rows} == {
        "hits": (2.0, 2.0, 0.0),
        "share": (pytest.approx(2 / 3), 1.0, pytest.approx(1 / 3)),
    }


def test_dictionary_round_trip(spark):
    rows = [(1, "a", "x"), (2, None, "x"), (3, "", "y"), (4, "a", None), (5, "é", "x")]
    df = spark.createDataFrame(rows, "id int, s string, t string")
    encoded, words = reduction.dictionary_encode(df, ["s", "t"])
    assert dict(encoded.dtypes) == {"id": "int", "s": "bigint", "t": "bigint"}
    assert sorted(r["id"] for r in words["s"].collect()) == [1, 2, 3]
    reduction.assert_same(reduction.dictionary_decode(encoded, words), df)


def test_large_dictionary_ids_are_dense(spark):
    df = spark.range(30_000).select(F.col("id").cast("string").alias("s"))
    ids = [r["id"] for r in reduction.dictionary(df, "s").collect()]
    assert sorted(ids) == list(range(1, 30_001))


def test_differences_count_copies(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "n int, s string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "n int, s string")
    rows = {tuple(r) for r in reduction.table_differences(a, b).collect()}
    assert rows == {(1, None, 2, 1), (3, "y", 0, 1)}
    reduction.assert_same(a, a.repartition(3))
    for other in (b, a.toDF("m", "s"), a.withColumn("n", F.col("n").cast("bigint"))):
        with pytest.raises(AssertionError):
            reduction.assert_same(a, other)


def test_fingerprint(spark):
    df = spark.createDataFrame([("a", None, 1.5), ("b", "c", 2.0)], "x string, y string, z double")

    def print_of(rows):
        return fingerprint(rows, ["x", "y", "z"]).first()

    same = df.repartition(4, "x").orderBy(F.desc("x"))
    assert print_of(df) == print_of(same)
    moved = df.select(F.col("y").alias("x"), F.col("x").alias("y"), "z")
    marked = df.withColumn("y", F.coalesce("y", F.lit("\\N")))
    doubled = df.union(df.filter("x = 'a'"))
    prints = [print_of(t) for t in (df, moved, marked, doubled, df.limit(0))]
    assert len(set(prints)) == 5
    assert prints[-1] == (0, "0", "0")
    pairs = [("a\x1fb", "c"), ("a", "b\x1fc"), ("a\\", "c"), ("a", "\\c")]
    frames = [spark.createDataFrame([pair], "x string, y string") for pair in pairs]
    assert len({fingerprint(df).first() for df in frames}) == 4


def test_schemas_match_the_files(spark):
    for name, ddl in SCHEMAS.items():
        inferred = spark.read.parquet(f"{SF_DIR}/{name}.parquet").schema
        declared = read_table(spark, SF_DIR, name).schema
        assert inferred.simpleString() == declared.simpleString(), (name, ddl)
    assert multiset(read_table(spark, SF_DIR, "region"))

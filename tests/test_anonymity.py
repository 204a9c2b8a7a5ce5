import pytest
from pyspark.sql import functions as F

from seektrail.operators import anonymity
from seektrail.plans import hot


def people(spark, n=500):
    age = F.when(F.col("id") % 11 > 0, 18 + F.pmod(F.hash("id"), F.lit(60)))
    return spark.range(n).select(
        "id", age.cast("int").alias("age"), (F.col("id") % 7).alias("area"), (F.col("id") % 3).alias("illness")
    )


@pytest.mark.parametrize("k", [1, 5, 40, 300])
def test_classes_hold_k_rows_and_cover_all(spark, k):
    df = people(spark)
    rows = anonymity.anonymous_classes(df, ["age", "area"], "illness", k).collect()
    assert sum(r["rows"] for r in rows) == 500 and min(r["rows"] for r in rows) >= k
    # Nothing is left that could be cut at a median.
    assert (len(rows) == 1) == (k == 300)
    hidden = anonymity.generalize(df, ["age", "area"], "illness", k)
    assert set(hidden.columns) == {"id", "illness", "age_from", "age_to", "area_from", "area_to"}
    both = df.join(hidden.drop("illness"), "id")
    assert both.count() == 500
    outside = "age < age_from or age > age_to or area < area_from or area > area_to"
    assert both.filter(outside).count() == 0
    limits = ["age_from", "age_to", "area_from", "area_to"]
    assert anonymity.anonymity(hidden, limits, "illness").first()["k"] >= k


def test_small_odd_and_empty_tables(spark):
    schema = "x double, y int, s string"
    rows = [(None, 1, "a"), (None, 1, None), (float("nan"), 1, "b"), (2.0, 1, "b"), (2.0, 1, "b"), (9.0, None, "c")]
    df = spark.createDataFrame(rows, schema)
    found = anonymity.anonymous_classes(df, ["x", "y"], "s", 2).collect()
    assert sorted((r["rows"], r["values"]) for r in found) == [(3, 2), (3, 2)]
    assert [r["rows"] for r in anonymity.anonymous_classes(df, ["x", "y"], "s", 7).collect()] == [6]
    nothing = df.limit(0)
    assert anonymity.anonymous_classes(nothing, ["x", "y"], "s", 2).count() == 0
    assert anonymity.generalize(nothing, ["x", "y"], "s", 2).count() == 0
    assert anonymity.anonymity(nothing, ["x", "y"], "s").first() == (0, 0, None, None)
    for wrong in ({"k": 0}, {"k": 2, "levels": 61}):
        with pytest.raises(ValueError):
            anonymity.anonymous_classes(df, ["x", "y"], "s", **wrong)
    with pytest.raises(ValueError, match="not a number"):
        anonymity.anonymous_classes(df, ["s"], "y", 2)


def test_hot_cells_and_later_levels_give_the_same(spark, monkeypatch):
    df = people(spark).unionByName(people(spark).withColumns({"age": F.lit(30), "area": F.lit(2).cast("bigint")}))
    args = (["age", "area"], "illness", 10)
    expected = sorted(anonymity.generalize(df, *args).collect())
    monkeypatch.setattr(anonymity, "BROADCAST_LEVELS", -1)
    spark.conf.set("seektrail.hotRows", "100")
    try:
        hot.forget()
        assert sorted(anonymity.generalize(df, *args).collect()) == expected
    finally:
        spark.conf.unset("seektrail.hotRows")
        hot.forget()


@pytest.mark.parametrize("k", [1, 7])
@pytest.mark.parametrize("levels", [0, 3, 60])
def test_cut_by_one_task_or_by_all_gives_the_same(spark, monkeypatch, k, levels):
    often = people(spark, 40).withColumns({"age": F.lit(30), "area": F.lit(2).cast("bigint")})
    df = people(spark, 300).unionByName(often)

    def classes(most):
        monkeypatch.setattr(anonymity, "LOCAL_PLACES", most)
        return sorted(map(tuple, anonymity.anonymous_classes(df, ["age", "area"], "illness", k, levels).collect()), key=str)

    by_all = classes(0)
    assert classes(20) == by_all
    assert classes(50_000) == by_all


def test_small_classes_are_cut_without_a_job_per_level(spark):
    spark.sparkContext.setJobGroup("cuts", "cuts")
    try:
        found = anonymity.anonymous_classes(people(spark, 2_000), ["age", "area"], "illness", 2).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found > 100
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("cuts")) < 30

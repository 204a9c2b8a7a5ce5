import pytest
from fixtures import at, log_of, search
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seektrail.functions.hashing import fingerprint
from seektrail.operators.reduction import assert_same
from seektrail.operators.snapshots import as_of, key_history, latest, snapshot_diff
from seektrail.plans.stages import run_stages, stage_fingerprints
from seektrail.sources.model import SEARCH_LOG_SCHEMA
from seektrail.sources.snapshots import read_snapshot, versions, write_snapshot

SCHEMA = "k int, a string, b double"


def test_latest_breaks_ties_by_content(spark):
    rows = [(1, "x", 1.0), (1, "y", 1.0), (2, "z", 0.0), (2, "w", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    chosen = {r["k"]: r["a"] for r in latest(df, ["k"], ["b"]).collect()}
    assert chosen[2] == "z"
    for n in (1, 3):
        again = latest(df.repartition(n, "a").orderBy("a"), ["k"], ["b"])
        assert {r["k"]: r["a"] for r in again.collect()} == chosen
    plan = latest(df, ["k"], ["b"])._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan


def test_latest_of_rows_with_maps(spark):
    log = log_of(spark, search(1, at(0), area="a"), search(2, at(1), area="b"))
    assert [r["event_id"] for r in latest(log, ["user_id"], ["ts"]).collect()] == [2]


def test_diff_states(spark):
    old = spark.createDataFrame(
        [(1, "x", 1.0), (2, None, None), (3, None, 1.0), (4, "x", 1.0), (None, "n", 1.0)], SCHEMA
    )
    new = spark.createDataFrame(
        [(1, "x", 1.0), (2, None, None), (3, "x", 2.0), (5, "x", 1.0), (None, "n", None)], SCHEMA
    )
    rows = snapshot_diff(old, new, ["k"]).collect()
    assert {r["k"]: (r["state"], r["changed"]) for r in rows} == {
        1: ("same", []),
        2: ("same", []),
        3: ("changed", ["a", "b"]),
        4: ("removed", []),
        5: ("added", []),
        None: ("changed", ["b"]),
    }
    assert {r["state"] for r in snapshot_diff(old, old, ["k"]).collect()} == {"same"}
    all_keys = snapshot_diff(old, new, old.columns).collect()
    assert {r["state"] for r in all_keys} == {"same", "added", "removed"}


@pytest.mark.parametrize("repeated_side", [0, 1])
def test_repeated_keys_fail(spark, repeated_side):
    once = spark.createDataFrame([(1, "x", 1.0)], SCHEMA)
    sides = [once, once]
    sides[repeated_side] = once.union(once)
    with pytest.raises(PySparkException, match="repeated key"):
        snapshot_diff(*sides, ["k"]).collect()


def test_versions_side_by_side(spark, tmp_path):
    root = str(tmp_path)
    rows = [spark.createDataFrame([(n, "x", 1.0)], SCHEMA) for n in range(3)]
    for df, version in zip(rows, ("2025-05-02", "2025-05-02_v2", "2025-04-30"), strict=True):
        write_snapshot(df, root, "t", version)
    assert versions(spark, root, "t") == ["2025-04-30", "2025-05-02", "2025-05-02_v2"]
    newest = read_snapshot(spark, root, "t", SCHEMA)
    assert [tuple(r) for r in newest.collect()] == [(1, "x", 1.0, "2025-05-02_v2")]
    dated = read_snapshot(spark, root, "t", SCHEMA, "2025-05-02")
    assert [r["k"] for r in dated.collect()] == [0]
    assert all("snapshot=2025-05-02/" in f for f in dated.inputFiles())
    write_snapshot(rows[2], root, "t", "2025-05-02")
    assert [r["k"] for r in read_snapshot(spark, root, "t", SCHEMA, "2025-05-02").collect()] == [2]
    assert len(versions(spark, root, "t")) == 3


def test_snapshots_of_logs(spark, tmp_path):
    log = log_of(spark, search(1, at(0), area="a"))
    write_snapshot(log, str(tmp_path), "log", "v1")
    back = read_snapshot(spark, str(tmp_path), "log", SEARCH_LOG_SCHEMA)
    assert back.drop("snapshot").collect() == log.collect()


def test_stages_run_in_order_resume_and_reproduce(spark, tmp_path):
    calls = []

    def stage(name, build):
        def run(tables):
            calls.append(name)
            return build(tables)

        return name, run

    def stages(fail=False):
        def last(tables):
            if fail:
                raise RuntimeError("stop")
            return tables["even"].groupBy().count()

        return [stage("even", lambda t: t["numbers"].filter("id % 2 = 0")), stage("count", last)]

    inputs = {"numbers": spark.range(10)}
    with pytest.raises(RuntimeError):
        run_stages(spark, stages(fail=True), inputs, str(tmp_path))
    done = run_stages(spark, stages(), inputs, str(tmp_path), resume=True)
    assert calls == ["even", "count", "count"]
    assert done["count"].first()[0] == 5
    assert_same(spark.read.parquet(f"{tmp_path}/01_even"), inputs["numbers"].filter("id % 2 = 0"))
    again = run_stages(spark, stages(), inputs, f"{tmp_path}/again")
    assert_same(stage_fingerprints(done), stage_fingerprints(again))


def test_empty_and_odd_versions(spark, tmp_path):
    root, rows = str(tmp_path), spark.createDataFrame([(1, "x", 1.0)], SCHEMA)
    for version in ("v9", "v10"):
        write_snapshot(rows, root, "t", version)
    assert versions(spark, root, "t") == ["v9", "v10"]
    write_snapshot(rows.limit(0), root, "t", "v10")
    assert read_snapshot(spark, root, "t", SCHEMA).count() == 0
    assert read_snapshot(spark, root, "t", SCHEMA, "v9").count() == 1
    for call in (
        lambda: write_snapshot(rows, root, "t", "2025-01-01 10:00"),
        lambda: read_snapshot(spark, root, "t", SCHEMA, "v11"),
        lambda: read_snapshot(spark, root, "none", SCHEMA),
    ):
        with pytest.raises(ValueError):
            call()


def test_diff_sees_new_columns_and_maps_and_is_checked_when_counted(spark):
    old = spark.createDataFrame([(1, "x", 1.0)], SCHEMA)
    new = old.withColumn("w", F.lit(5))
    assert snapshot_diff(old, new, ["k"]).first()["changed"] == ["w"]
    assert snapshot_diff(new, old, ["k"]).first()["changed"] == ["w"]
    log = log_of(spark, search(1, at(0), area="a", price="b"))
    turned = log.withColumn("cond", F.map_from_entries(F.reverse(F.map_entries("cond"))))
    assert snapshot_diff(log, turned, ["event_id"]).first()["state"] == "same"
    assert_same(fingerprint(log), fingerprint(turned))
    with pytest.raises(PySparkException, match="repeated key"):
        snapshot_diff(old.union(old), new, ["k"]).count()


def test_a_rebuilt_stage_rebuilds_all_after_it(spark, tmp_path):
    stages = [("even", lambda t: t["n"].filter("id % 2 = 0")), ("count", lambda t: t["even"].groupBy().count())]
    run_stages(spark, stages, {"n": spark.range(10)}, str(tmp_path))
    (tmp_path / "01_even" / "_SUCCESS").unlink()
    again = run_stages(spark, stages, {"n": spark.range(10)}, str(tmp_path), resume=True)
    assert again["count"].first()[0] == 5
    changed = run_stages(spark, stages, {"n": spark.range(14)}, str(tmp_path), resume=True)
    assert changed["count"].first()[0] == 7


def test_a_run_that_breaks_off_leaves_nothing_stale(spark, tmp_path):
    def stages(fail):
        def total(t):
            if fail:
                raise RuntimeError("broken off")
            return t["half"].groupBy().agg(F.sum("n").alias("n"))

        return [
            ("half", lambda t: t["rows"].groupBy().agg(F.count(F.lit(1)).alias("n"))),
            ("total", total),
            ("tens", lambda t: t["total"].selectExpr("n", "n * 10 AS m")),
        ]

    first, second = {"rows": spark.range(3)}, {"rows": spark.range(7)}
    assert tuple(run_stages(spark, stages(False), first, str(tmp_path))["tens"].first()) == (3, 30)
    with pytest.raises(RuntimeError):
        run_stages(spark, stages(True), second, str(tmp_path))
    done = run_stages(spark, stages(False), second, str(tmp_path), resume=True)
    assert tuple(done["tens"].first()) == (7, 70)
    again = run_stages(spark, stages(False), first, str(tmp_path), resume=True)
    assert tuple(again["tens"].first()) == (3, 30)


def test_changed_code_and_a_half_written_stage_are_run_again(spark, tmp_path):
    calls = []

    def stages(times):
        def rows(t):
            calls.append("rows")
            return t["n"].filter("id > 1")

        def scaled(t):
            calls.append("scaled")
            return t["rows"].selectExpr(f"id * {times} AS id")

        return [("rows", rows), ("scaled", scaled)]

    def run(times):
        calls.clear()
        result = run_stages(spark, stages(times), {"n": spark.range(4)}, str(tmp_path), resume=True)
        return sorted(r["id"] for r in result["scaled"].collect()), list(calls)

    assert run(2) == ([4, 6], ["rows", "scaled"])
    assert run(2) == ([4, 6], [])
    assert run(3) == ([6, 9], ["scaled"])
    # As left by a run that ended while it wrote the result again: complete files, empty manifest.
    empty = spark.createDataFrame([], "made_from string, schema string")
    empty.write.mode("overwrite").parquet(f"{tmp_path}/manifests/01_rows")
    assert run(3) == ([6, 9], ["rows", "scaled"])


def test_history_of_keys(spark):
    states = {
        "v1": {1: "a", 2: "x", 3: None, 5: "e"},
        "v2": {1: "a", 2: "y", 3: None},
        "v3": {1: "b", 4: "n", 3: "", 5: "e"},
        "v4": {1: "a", 4: "n", 3: "", 5: "e"},
    }
    rows = [(v, k, a) for v, table in states.items() for k, a in table.items()]
    df = spark.createDataFrame([*rows, rows[0]], "snapshot string, k int, a string").repartition(3)
    history = key_history(df, ["k"], "snapshot")
    assert set(map(tuple, history.collect())) == {
        (1, "a", "v1", "v3"), (1, "b", "v3", "v4"), (1, "a", "v4", None), (2, "x", "v1", "v2"), (2, "y", "v2", "v3"),
        (3, None, "v1", "v3"), (3, "", "v3", None), (4, "n", "v3", None), (5, "e", "v1", "v2"), (5, "e", "v3", None),
    }
    asked = spark.createDataFrame([(k, v) for k in range(1, 7) for v in states], "k int, at string")
    found = {(r["k"], r["at"]): (r["a"], r["valid_from"] is not None) for r in as_of(asked, history, ["k"], "at").collect()}
    assert found == {(k, v): (states[v].get(k), k in states[v]) for k in range(1, 7) for v in states}
    assert key_history(df.limit(0), ["k"], "snapshot").collect() == []


def test_a_version_with_a_key_twice_has_no_history(spark):
    df = spark.createDataFrame([("v1", 1, "a"), ("v1", 1, "b")], "snapshot string, k int, a string")
    with pytest.raises(PySparkException):
        key_history(df, ["k"], "snapshot").collect()


def by_version(spark, df):
    """Shuffles by version in the plan, if tables are too large to be broadcast for their size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return plan.count("hashpartitioning(snapshot")


def test_states_as_of_do_not_bring_the_rows_of_a_version_together(spark, tmp_path):
    versions = spark.range(300).selectExpr("concat('v', id % 3) AS snapshot", "id DIV 3 AS k", "id % 7 AS a")
    versions.write.parquet(f"{tmp_path}/versions")
    versions = spark.read.parquet(f"{tmp_path}/versions")
    asked = spark.range(100).selectExpr("id AS k", "'v1' AS at")
    found = as_of(asked, key_history(versions, ["k"], "snapshot"), ["k"], "at")
    # The list of versions is made by the only one.
    assert by_version(spark, found) == 1
    assert {r["k"]: r["a"] for r in found.collect()} == {k: (3 * k + 1) % 7 for k in range(100)}


def test_history_does_not_bring_the_rows_of_a_version_together(spark, tmp_path):
    versions = spark.range(300).selectExpr("concat('v', id % 3) AS snapshot", "id DIV 3 AS k", "'same' AS a")
    versions.write.parquet(f"{tmp_path}/versions")
    history = key_history(spark.read.parquet(f"{tmp_path}/versions"), ["k"], "snapshot")
    assert by_version(spark, history) == 1
    assert set(map(tuple, history.collect())) == {(k, "same", "v0", None) for k in range(100)}

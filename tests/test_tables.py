import hashlib
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from fixtures import at, detail, log_of, search
from pyspark.sql import functions as F

from seektrail.functions.conditions import no_result
from seektrail.operators import tables
from seektrail.operators.tables import clustered_comparison
from seektrail.plans.percentiles import exact_percentiles


def test_rollup_levels_and_estimate(spark):
    log = log_of(
        spark, search(1, at(0)), search(2, at(1), user=2), detail(3, at(2)), detail(4, at(3))
    )
    exact = tables.behaviour_rollup(log, ["kind"])
    assert {tuple(r) for r in exact.collect()} == {
        ("search", 0, 2, 2),
        ("detail", 0, 2, 1),
        (None, 1, 4, 2),
    }
    estimate = tables.behaviour_rollup(log, ["kind"], approx=True)
    assert {tuple(r) for r in estimate.collect()} == {tuple(r) for r in exact.collect()}


def test_cube_has_every_combination(spark):
    log = log_of(spark, search(1, at(0)), detail(2, at(1)))
    rows = tables.behaviour_rollup(log, ["kind", "user_id"], cube=True).collect()
    assert {r["level"] for r in rows} == {0, 1, 2, 3}


def test_trend_counts_days_not_rows(spark):
    days = [0, 1, 5, 6]
    log = log_of(spark, *[search(i, at(60 * 24 * d), results=0) for i, d in enumerate(days)])
    rows = tables.daily_trend(log, F.count_if(no_result()), days=3).orderBy("day").collect()
    assert [(r["value"], r["rolling"]) for r in rows] == [(1, 1), (1, 2), (1, 1), (1, 2)]
    by_user = tables.daily_trend(log, F.count(F.lit(1)), days=3, by=["user_id"])
    assert by_user.columns == ["user_id", "day", "value", "rolling"]


@pytest.mark.parametrize("spread", [10, 5_000_000, 40_000_000])
def test_percentiles_are_exact(spark, spread):
    rng = np.random.default_rng(1)
    groups = {"a": rng.integers(0, spread, 501), "b": rng.integers(0, spread, 8), None: [spread]}
    rows = [(g, int(v)) for g, values in groups.items() for v in values] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v bigint")
    wanted = [0.0, 0.1, 0.5, 0.99, 1.0]
    found = {
        (r["g"], r["p"]): (r["rows"], r["value"])
        for r in exact_percentiles(df, "v", wanted, ["g"]).collect()
    }
    assert len(found) == 15
    for (group, p), (count, value) in found.items():
        assert count == len(groups[group])
        assert value == pytest.approx(np.quantile(groups[group], p), abs=1e-6)


def test_percentiles_without_groups(spark):
    df = spark.createDataFrame([(-3,), (-1,), (2,)], "v bigint")
    rows = exact_percentiles(df, "v", [0.25, 0.5]).collect()
    assert {(r["p"], r["value"]) for r in rows} == {(0.25, -2.0), (0.5, -1.0)}
    assert exact_percentiles(df.limit(0), "v", [0.5]).count() == 0


def test_time_to_detail_keeps_microseconds(spark):
    log = log_of(spark, search(1, at(0)), detail(2, at(0, 1)), search(3, at(9)), detail(4, at(10)))
    rows = tables.time_to_detail(log, timedelta(hours=1), [0.0, 1.0]).collect()
    assert {(r["p"], r["entries"], r["seconds"]) for r in rows} == {
        (0.0, 2, 0.000001),
        (1.0, 2, 60.0),
    }


def test_durations_ignore_the_time_zone(spark):
    from seektrail.functions.rates import micros_between

    df = spark.createDataFrame(
        [(datetime(2026, 3, 29, 0, 30), datetime(2026, 3, 29, 4, 30))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    spark.conf.set("spark.sql.session.timeZone", "Europe/Paris")
    try:
        assert df.select(micros_between("a", "b")).first()[0] == 4 * 3600 * 10**6
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def compared(spark, rows):
    df = spark.createDataFrame(rows, "g string, hit boolean")
    return tables.compare_groups(df, F.col("g"), F.col("hit"), "a", "b").first()


def test_compare_groups(spark):
    rows = [("a", i < 30) for i in range(100)] + [("b", i < 15) for i in range(100)]
    row = compared(spark, rows + [("c", True), (None, True), ("a", None)])
    assert (row["n_a"], row["hits_a"], row["n_b"], row["hits_b"]) == (100, 30, 100, 15)
    assert row["difference"] == pytest.approx(0.15)
    assert row["z"] == pytest.approx(0.15 / (0.225 * 0.775 * 0.02) ** 0.5)


@pytest.mark.parametrize(
    "rows",
    [[], [("a", True), ("a", False)], [("a", True), ("b", True)], [("a", False), ("b", False)]],
)
def test_no_z_without_variation_or_group(spark, rows):
    assert compared(spark, rows)["z"] is None


def plain_comparison(rows, replicates, seed):
    """rows: (cluster, group, flag)."""
    clusters = {}
    for c, g, f in rows:
        if c is not None and f is not None and g in "ab":
            n = clusters.setdefault(c, {"a": [0, 0], "b": [0, 0]})[g]
            n[0], n[1] = n[0] + 1, n[1] + f
    limits = [int(2**32 * math.exp(-1) * sum(1 / math.factorial(k) for k in range(n + 1))) for n in range(12)]

    def difference(weights):
        sums = {g: [sum(w * clusters[c][g][k] for c, w in weights.items()) for k in (0, 1)] for g in "ab"}
        if sums["a"][0] and sums["b"][0]:
            return sums["a"][1] / sums["a"][0] - sums["b"][1] / sums["b"][0]

    found = []
    for r in range(replicates):
        weights = {}
        for c in clusters:
            digest = hashlib.md5(f"{seed}:{c}:{r // 4}".encode()).hexdigest()
            weights[c] = sum(int(digest[8 * (r % 4) :][:8], 16) >= x for x in limits)
        found.append(difference(weights))
    found = np.array([d for d in found if d is not None])
    sides = min((found <= 0).mean(), (found >= 0).mean())
    return (
        len(clusters), difference(dict.fromkeys(clusters, 1)), *np.quantile(found, [0.025, 0.975]), min(1, 2 * sides), len(found),
    )


def test_clustered_comparison_equals_plain_python(spark):
    random = np.random.default_rng(3)
    rows = []
    for c in range(40):
        lean = random.random()
        for _ in range(random.integers(1, 30)):
            rows.append((c, "ab"[random.integers(2)], bool(random.random() < lean)))
    rows += [(None, "a", True), (1, "c", True), (2, "a", None)]
    df = spark.createDataFrame(rows, "user int, kind string, hit boolean").repartition(3)
    result = clustered_comparison(df, "user", F.col("kind"), F.col("hit"), "a", "b", replicates=90, seed=5)
    expected = plain_comparison(rows, 90, 5)
    assert tuple(result.first()) == pytest.approx(expected)
    again = clustered_comparison(df.repartition(7), "user", F.col("kind"), F.col("hit"), "a", "b", 90, seed=5)
    assert again.first() == result.first()


def test_clustered_interval_is_wider_where_users_differ(spark):
    # Every user has one outcome only: 30 users are 30 observations, however many rows they have.
    rows = [(u, "ab"[u % 2], u % 3 == 0) for u in range(30) for _ in range(50)]
    df = spark.createDataFrame(rows, "user int, kind string, hit boolean")
    alone = df.withColumn("row", F.monotonically_increasing_id())
    wide, narrow = (
        clustered_comparison(x, c, F.col("kind"), F.col("hit"), "a", "b", 200).first()
        for x, c in ((df, "user"), (alone, "row"))
    )
    assert wide["high"] - wide["low"] > 4 * (narrow["high"] - narrow["low"])
    assert wide["low"] < wide["difference"] < wide["high"]


def test_clustered_comparison_without_a_group(spark):
    df = spark.createDataFrame([(1, "a", True)], "user int, kind string, hit boolean")
    row = clustered_comparison(df, "user", F.col("kind"), F.col("hit"), "a", "b", 20).first()
    assert tuple(row) == (1, None, None, None, None, 0)
    row = clustered_comparison(df.limit(0), "user", F.col("kind"), F.col("hit"), "a", "b", 20).first()
    assert (row["clusters"], row["difference"], row["replicates"]) == (0, None, 0)


def test_rolling_users_exact_and_by_sketch(spark):
    random = np.random.default_rng(6)
    days = [d for d in range(40) if d % 11]
    rows = [
        (k, at(int(1440 * days[random.integers(len(days))] + random.integers(1440))), int(random.integers(4_000)), ["search", "detail", None][random.integers(3)], 1, {})
        for k in range(9_000)
    ]
    rows += [(9_001, at(0), None, "search", 1, {}), (9_002, None, 3, "search", 1, {})]
    log = log_of(spark, *rows).repartition(4)

    def plain(length, kinds):
        users = {}
        for _, ts, user, kind, *_ in rows:
            if user is not None and ts is not None:
                users.setdefault((kind if kinds else 0, ts.date()), set()).add(user)
        return {
            (*([g] if kinds else []), d): len(set().union(*(u for (h, e), u in users.items() if h == g and 0 <= (d - e).days < length)))
            for g, d in users
        }

    for length, by in ((1, []), (7, []), (7, ["kind"])):
        exact = {tuple(r)[:-1]: r["users"] for r in tables.rolling_users(log, length, by).collect()}
        assert exact == plain(length, bool(by))
        sketches = tables.user_sketches(log, ["kind"])
        near = {tuple(r)[:-1]: r["users"] for r in tables.users_of(sketches, length, by).collect()}
        assert near.keys() == exact.keys()
        assert all(abs(near[k] - n) <= max(2, 0.08 * n) for k, n in exact.items())
    assert tables.rolling_users(log.limit(0), 7).collect() == []

"""Hot keys change the plan and never the result."""

import random
from contextlib import contextmanager
from datetime import timedelta
from types import SimpleNamespace

import pytest
from fixtures import at, detail, log_of, multiset, other, search
from pyspark.sql import functions as F

from seektrail.operators import behaviour, quality, reduction, sessions, tables
from seektrail.plans import hot
from seektrail.sources.model import ForeignKey

W = timedelta(minutes=30)


@contextmanager
def setting(spark, name, value):
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name)


def skewed_log(spark, seed, burst):
    """A third of the rows belong to user 0, and as many to no known user.

    With `burst`, user 0 does nearly everything in one second, much of it at the same moment.
    """
    rng = random.Random(seed)
    rows = []
    for event_id in range(900):
        user = rng.choice([0, 0, 0, None, None, None, *range(1, 4)])
        micros = rng.randrange(10) * 100_000 if burst and user == 0 else rng.randrange(10**11)
        make = rng.choice([search, search, detail, other])
        ts = at(0, micros)
        if make is search:
            cond = {"area": str(rng.randrange(2)), "price": str(rng.randrange(2))}
            rows.append(search(event_id, ts, user, results=rng.randrange(2), **cond))
        else:
            rows.append(make(event_id, ts, user))
    return log_of(spark, *rows)


OPERATORS = {
    "re_search": lambda log: behaviour.re_search(log, W),
    "condition_change": lambda log: behaviour.condition_change(log, W),
    "detail_entry": lambda log: behaviour.detail_entry(log, W),
    "no_result_recovery": lambda log: behaviour.no_result_recovery(log, W),
    "detail_attribution": lambda log: behaviour.detail_attribution(log, W),
    "search_sessions": lambda log: sessions.search_sessions(log, W),
    "transitions": sessions.transitions,
    "session_paths": lambda log: sessions.session_paths(log, W, max_len=4),
    "time_to_detail": lambda log: tables.time_to_detail(log, W, [0.25, 0.5, 1.0], ["user_id"]),
}


@pytest.mark.parametrize("burst", [False, True])
@pytest.mark.parametrize("name", OPERATORS)
def test_cut_timelines_give_the_same_result(spark, name, burst):
    log = skewed_log(spark, 5, burst).cache()
    whole = multiset(OPERATORS[name](log))
    with setting(spark, "seektrail.hotRows", "25"):
        cut = hot.spread_users(log)
        assert cut.filter("slice > 0").select("user_id", "slice").distinct().count() > 20
        assert multiset(OPERATORS[name](log)) == whole
        assert multiset(OPERATORS[name](cut)) == whole


def test_slices_are_even_and_in_time_order(spark):
    log = skewed_log(spark, 6, burst=True)
    with setting(spark, "seektrail.hotRows", "50"):
        cut = hot.spread_users(log)
    assert multiset(cut.drop("slice")) == multiset(log)
    sizes = [r["count"] for r in cut.filter("slice > 0").groupBy("slice").count().collect()]
    assert max(sizes) <= 60
    rows = cut.filter("user_id = 0").orderBy("ts", "event_id").collect()
    slices = [r["slice"] for r in rows]
    assert slices == sorted(slices) and len(set(slices)) > 5


def test_copies_of_one_event_are_split(spark):
    one = search(10**6, at(3), user=0, results=0, area="a")
    log = skewed_log(spark, 9, burst=False).union(log_of(spark, *[one] * 450)).repartition(16)
    log = log.cache()
    whole = {name: multiset(operator(log)) for name, operator in OPERATORS.items()}
    with setting(spark, "seektrail.hotRows", "50"):
        cut = hot.spread_users(log)
        copies = cut.filter("event_id = 1000000").groupBy("slice").count()
        assert copies.agg(F.max("count")).first()[0] <= 100
        assert {name: multiset(operator(cut)) for name, operator in OPERATORS.items()} == whole


def test_ordinary_logs_are_not_cut(spark):
    log = skewed_log(spark, 7, burst=False)
    assert "slice" not in hot.spread_users(log).columns
    plan = behaviour.re_search(log, W)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "RangePartitioning" not in plan


def test_hot_keys_are_found_on_a_sample(spark):
    keys = spark.range(400_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("k")
    )
    with setting(spark, "seektrail.hotRows", "100000"):
        found = hot.hot_keys(keys, ["k"])
    assert [r["k"] for r in found] == [None]
    assert found[0]["rows"] == pytest.approx(133_333, rel=0.1)


def hot_tables(spark):
    child = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 7)
        .when(F.col("id") % 3 == 1, F.lit(None))
        .otherwise(F.col("id") % 50)
        .cast("bigint")
        .alias("k"),
    )
    parent = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("twice"))
    return child, parent


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("with_hot_parent", [True, False])
def test_joins_of_hot_keys_equal_plain_ones(spark, how, with_hot_parent):
    child, parent = hot_tables(spark)
    if not with_hot_parent:
        parent = parent.filter("k <> 7")
    plain = multiset(child.join(parent, "k", how))
    with setting(spark, "seektrail.hotRows", "100"):
        joined = hot.join_parent(child, parent, ["k"], how)
        assert "hot_k" in joined._jdf.queryExecution().analyzed().toString()
        assert multiset(joined) == plain


@pytest.mark.parametrize("columns", [["id", "k"], ["k"]])
def test_hot_rows_of_a_clustered_child_are_not_shuffled(spark, columns):
    child, parent = hot_tables(spark)
    child = hot.stored(child.select(*columns).repartition(4, "k").sortWithinPartitions("k"), "child")
    with (
        setting(spark, "seektrail.hotRows", "100"),
        setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"),
        setting(spark, "spark.sql.adaptive.enabled", "false"),
    ):
        joined = hot.join_parent(child, parent, ["k"], "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert multiset(joined) == multiset(child.join(parent, "k", "left"))
    # The rows of other keys and the parents are shuffled; hot rows meet a broadcast where they are.
    assert plan.count("Exchange hashpartitioning(k") == 2 and plan.count("SortMergeJoin") == 1
    assert plan.rindex("BroadcastHashJoin [k") > plan.index("SortMergeJoin")


def test_quality_and_reduction_with_hot_keys(spark):
    child, parent = hot_tables(spark)
    children = child.withColumn("at", F.timestamp_seconds("id").cast("timestamp_ntz"))
    parents = parent.withColumn("at", F.timestamp_seconds("twice").cast("timestamp_ntz"))
    text = child.select("id", F.concat(F.lit("value "), F.col("k").cast("string")).alias("v"))
    fks = [ForeignKey("child", ("k",), "parent", ("k",))]

    def results():
        subset = reduction.referential_subset(
            {"child": child, "parent": parent}, fks, "parent", "k", 0.5
        )
        encoded, words = reduction.dictionary_encode(text, ["v"])
        return [
            multiset(quality.orphans(child, ["k"], parent, ["k"])),
            multiset(quality.check_time_order(children, ["k"], "at", parents, ["k"], "at")),
            multiset(subset["child"]),
            multiset(encoded),
            multiset(reduction.dictionary_decode(encoded, words)),
        ]

    plain = results()
    with setting(spark, "seektrail.hotRows", "100"):
        assert results() == plain
    assert plain[-1] == multiset(text)


def test_dictionaries_of_hot_values_are_sent_to_them(spark, monkeypatch):
    child, _ = hot_tables(spark)
    text = child.select("id", F.col("k").cast("string").alias("v"))
    with setting(spark, "seektrail.hotRows", "100"):
        encoded, words = reduction.dictionary_encode(text, ["v"])
        assert "hot_v" in encoded._jdf.queryExecution().analyzed().toString()
        reduction.assert_same(reduction.dictionary_decode(encoded, words), text)


def session_stub(master, folder=None):
    made = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append
    )
    conf = SimpleNamespace(get=lambda name, default: folder or default)
    return SimpleNamespace(sparkContext=context, conf=conf), made


def test_shared_folder_is_the_one_the_cluster_names():
    session, made = session_stub("spark://cluster", "hdfs://shared")
    assert hot.shared_dir(session) == "hdfs://shared" and not made
    session, made = session_stub("spark://cluster")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        hot.shared_dir(session)
    session, made = session_stub("local[2]")
    assert [hot.shared_dir(session)] == made


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_results_do_not_depend_on_partitioning(spark, partitions):
    from seektrail.functions.hashing import fingerprint

    log = skewed_log(spark, 8, burst=False)
    expected = fingerprint(OPERATORS["search_sessions"](log)).first()
    with setting(spark, "spark.sql.shuffle.partitions", partitions):
        again = OPERATORS["search_sessions"](log.repartition(5, "event_id"))
        assert fingerprint(again).first() == expected

"""The queries of this repository over the supplied tables, and their SQL counterparts."""

from __future__ import annotations

import importlib.util
import sys
from collections.abc import Callable
from datetime import timedelta
from pathlib import Path
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if str(Path(__file__).parent) not in sys.path:
    sys.path.insert(0, str(Path(__file__).parent))

from seektrail.functions.conditions import no_result, step
from seektrail.functions.hashing import fingerprint as table_fingerprint
from seektrail.operators import (
    anonymity,
    behaviour,
    discovery,
    journeys,
    privacy,
    quality,
    reduction,
    sequences,
    sessions,
    snapshots,
    tables,
)
from seektrail.plans.hot import shared_dir, stored
from seektrail.plans.stages import run_stages
from seektrail.sources.hash_trees import changed_rows as changed_in_buckets
from seektrail.sources.hash_trees import write_hashed
from seektrail.sources.model import FOREIGN_KEYS, SCHEMAS
from seektrail.sources.snapshots import read_snapshot, write_snapshot
from seektrail.sources.tables import read_table, search_log

# The stand-in log has a median of over seven hours between a user's events.
WITHIN = timedelta(hours=6)
# Steps that end without or after a repeated search without results.
PATTERNS = {
    "found after none": "search no_result+ search detail",
    "gave up": "no_result no_result+ other",
    "looked on": "no_result+ search",
    "details only": "detail detail+",
}
PATTERN_WITHIN = timedelta(days=2)
SALT = "example salt"
SUBSET = 0.2
PEOPLE = 1_000
NATIONS = 0.3
# What others may know of an order, and how many orders must share it.
KNOWN = ("c_nationkey", "o_totalprice", "order_day")
HIDDEN_AMONG = 20

RULES = (
    quality.not_null("orders", "o_custkey"),
    quality.in_range("orders", "o_totalprice", 1000.0, 400000.0),
    quality.matches("orders", "o_orderpriority", "^[1-5]-[A-Z ]+$"),
    quality.in_range("lineitem", "l_discount", 0.0, 0.05),
    quality.in_range("lineitem", "l_quantity", 1.0, 45.0),
    quality.matches("customer", "c_name", "^Customer#[0-9]{9}$"),
    quality.UniqueKey("order key", "orders", ("o_orderkey",)),
    quality.UniqueKey("line key", "lineitem", ("l_orderkey", "l_linenumber")),
    quality.Reference("order of line", "lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    quality.Reference("label of document", "documents", ("doc_id",), "labels", ("doc_id",)),
    quality.TimeOrder(
        "shipped after order",
        "lineitem",
        ("l_orderkey",),
        "l_shipdate",
        "orders",
        ("o_orderkey",),
        "o_orderdate",
    ),
)
ORDER_RULES = tuple(r for r in RULES if isinstance(r, quality.RowRule) and r.table == "orders")


def _log(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    return search_log(events, kinds) if kinds else search_log(events)


def _tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, sf_dir, name) for name in names}


def _fixed_text(df: DataFrame) -> DataFrame:
    """Doubles in ten-thousandths and times to the microsecond, as engines print both differently."""
    forms = {
        "double": lambda c: F.floor(F.col(c) * 10000 + 0.5),
        "timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    }
    return df.withColumns({c: forms[kind](c) for c, kind in df.dtypes if kind in forms})


def no_result_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.no_result_rate(_log(spark, sf_dir, "search"), [F.to_date("ts").alias("day")])


def re_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.re_search(_log(spark, sf_dir, "search"), WITHIN)


def condition_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = behaviour.condition_change(_log(spark, sf_dir, "search"), WITHIN)
    return changes.withColumn("changed", F.array_join("changed", ","))


def detail_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.detail_entry(_log(spark, sf_dir, "search", "detail"), WITHIN)


def no_result_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.no_result_recovery(_log(spark, sf_dir, "search", "detail"), WITHIN)


def detail_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.detail_attribution(_log(spark, sf_dir, "search", "detail"), WITHIN)


def no_result_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.no_result_conditions(_log(spark, sf_dir, "search"), n=10)


def search_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.search_sessions(_log(spark, sf_dir), WITHIN)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.transitions(_log(spark, sf_dir))


def session_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_paths(_log(spark, sf_dir), WITHIN, max_len=5)


def behaviour_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return tables.behaviour_rollup(log, ["day", "kind"])


def behaviour_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumn("area", F.col("cond")["area"])
    return tables.behaviour_rollup(log, ["area", "kind"], cube=True)


def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir, "search")
    return tables.daily_trend(log, F.count_if(no_result()), days=7)


def rolling_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.rolling_users(_log(spark, sf_dir), days=7, by=["kind"])


def frequent_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by area, with and without results, that follow each other for 4 users in 10."""
    log = _log(spark, sf_dir, "search")
    item = F.concat_ws(" ", step(), F.col("cond")["area"])
    found = sequences.frequent_sequences(log, "user_id", ["ts", "event_id"], item, 0.4, longest=3)
    return found.withColumn("pattern", F.array_join("pattern", " > "))


def pii_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pii_report(_tables(spark, sf_dir, "customer", "documents", "part"))


def subset_of_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a given number of customers."""
    names = ("customer", "orders", "lineitem", "events")
    small = reduction.referential_subset(
        _tables(spark, sf_dir, *names), FOREIGN_KEYS, "customer", "c_custkey", root_rows=PEOPLE
    )
    return small["events"]


def time_to_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir, "search", "detail")
    result = tables.time_to_detail(log, WITHIN, [0.1, 0.5, 0.9], by=["result_count"])
    return result.withColumn("seconds", F.round("seconds", 4))


def compare_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = behaviour.detail_entry(_log(spark, sf_dir, "search", "detail"), WITHIN)
    found = F.col("result_count") > 0
    result = tables.compare_groups(entries, found, F.col("entered"), True, False)
    return result.withColumns({c: F.round(c, 6) for c in ("difference", "z")})


def clustered_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = behaviour.detail_entry(_log(spark, sf_dir, "search", "detail"), WITHIN)
    found = F.col("result_count") > 0
    result = tables.clustered_comparison(
        entries, "user_id", found, F.col("entered"), True, False, replicates=200
    )
    return result.withColumns({c: F.round(c, 6) for c in ("difference", "low", "high", "p_value")})


def pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journeys.pattern_matches(_log(spark, sf_dir), PATTERNS, PATTERN_WITHIN)


def journey_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journeys.journey_patterns(_log(spark, sf_dir), PATTERNS, PATTERN_WITHIN)


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("orders", "lineitem", "customer", "documents", "labels")
    return quality.quality_report(_tables(spark, sf_dir, *names), RULES)


def row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.check_rows(read_table(spark, sf_dir, "orders"), ORDER_RULES)


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    return quality.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


def minimal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of up to three columns of orders, and of up to two of lineitem."""
    found = [
        discovery.minimal_keys(read_table(spark, sf_dir, name), largest=largest).withColumn("table", F.lit(name))
        for name, largest in (("orders", 3), ("lineitem", 2))
    ]
    return found[0].unionByName(found[1]).select("table", F.array_join("columns", ",").alias("columns"))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows from what in the lines with their orders, customers and nations."""
    t = _tables(spark, sf_dir, "lineitem", "orders", "customer", "nation")
    # The lines come last, so they are shuffled once.
    orders = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    orders = orders.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    wide = t["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    columns = (
        "l_orderkey", "l_suppkey", "o_custkey", "o_orderdate", "c_nationkey", "c_mktsegment", "n_name",
        "n_regionkey",
    )
    wide = stored(wide.select(*columns), "wide")
    return discovery.dependencies(wide, largest=2).withColumn("columns", F.array_join("columns", ","))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir, "documents", "labels")
    documents = t["documents"].select("doc_id", "lang", "source")
    return quality.orphans(documents, ["doc_id"], t["labels"], ["doc_id"])


def time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir, "lineitem", "orders")
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return quality.too_early(
        lines, ["l_orderkey"], "l_shipdate", t["orders"], ["o_orderkey"], "o_orderdate"
    )


def quarantine_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quarantine(read_table(spark, sf_dir, "orders"), ORDER_RULES)[0]


def quarantine_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = quality.quarantine(read_table(spark, sf_dir, "orders"), ORDER_RULES)[1]
    return rejected.withColumn("failed_rules", F.array_join("failed_rules", ","))


def pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = privacy.pseudonymize(
        _tables(spark, sf_dir, "customer", "events", "orders"),
        {"customer": ["c_custkey", "c_name"], "events": ["user_id"], "orders": ["o_custkey"]},
        SALT,
    )
    per_user = hidden["events"].groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    ordered = hidden["orders"].withColumnRenamed("o_custkey", "user_id")
    ordered = ordered.groupBy("user_id").agg(F.count(F.lit(1)).alias("orders"))
    customers = hidden["customer"].withColumnRenamed("c_custkey", "user_id")
    return customers.join(per_user, "user_id", "left").join(ordered, "user_id", "left")


def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.pii_scan(read_table(spark, sf_dir, "documents"), "text")


def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return privacy.pii_mask(documents, "text")


def _known_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir, "orders", "customer")
    orders = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    return orders.select("c_nationkey", "o_totalprice", day.alias("order_day"), "o_orderpriority")


def anonymous_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are not told apart by nation, price and day, in classes of at least 20."""
    return anonymity.anonymous_classes(_known_orders(spark, sf_dir), KNOWN, "o_orderpriority", HIDDEN_AMONG)


def anonymity_before_and_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest classes and fewest priorities in one, as the orders are and generalised."""
    orders = _known_orders(spark, sf_dir)
    hidden = anonymity.generalize(orders, KNOWN, "o_orderpriority", HIDDEN_AMONG)
    limits = [f"{c}_{end}" for c in KNOWN for end in ("from", "to")]
    before = anonymity.anonymity(orders, KNOWN, "o_orderpriority").withColumn("stage", F.lit("before"))
    after = anonymity.anonymity(hidden, limits, "o_orderpriority").withColumn("stage", F.lit("after"))
    return before.unionByName(after)


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.column_profile(_fixed_text(read_table(spark, sf_dir, "orders")))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.dictionary(read_table(spark, sf_dir, "customer"), "c_name")


def _subset(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = ("region", "nation", "customer", "orders", "lineitem", "events")
    return reduction.referential_subset(
        _tables(spark, sf_dir, *names), FOREIGN_KEYS, "customer", "c_custkey", SUBSET
    )


def referential_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subset(spark, sf_dir)["lineitem"]


def referential_subset_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subset(spark, sf_dir)["orders"]


def broken_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that a subset of the nations leaves without a parent: none."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    small = reduction.referential_subset(
        _tables(spark, sf_dir, *names), FOREIGN_KEYS, "nation", "n_nationkey", NATIONS
    )
    return reduction.broken_references(small, FOREIGN_KEYS)


def sample_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {
        f"share_{t}": F.count_if(F.col("event_type") == t) / F.count(F.lit(1))
        for t in ("view", "error", "click")
    }
    full = read_table(spark, sf_dir, "events")
    drift = reduction.sample_drift(full, _subset(spark, sf_dir)["events"], kinds)
    return drift.withColumn("difference", F.round("difference", 6))


def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    return reduction.dictionary_encode(orders, ["o_orderstatus", "o_orderpriority"])[0]


def dictionary_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read_table(spark, sf_dir, "part")
    return reduction.dictionary_decode(*reduction.dictionary_encode(parts, ["p_name", "p_brand"]))


def table_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    returned = F.when(F.col("l_returnflag") == "R", "A").otherwise(F.col("l_returnflag"))
    return reduction.table_differences(lines, lines.withColumn("l_returnflag", returned))


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    return snapshots.latest(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


def _order_versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the orders that overlap, with the status of urgent ones changed."""
    orders = read_table(spark, sf_dir, "orders")
    old = orders.filter("o_orderpriority <> '5-LOW'")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    status = F.when(urgent, "X").otherwise(F.col("o_orderstatus"))
    return old, orders.filter("o_orderstatus <> 'F'").withColumn("o_orderstatus", status)


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = snapshots.snapshot_diff(*_order_versions(spark, sf_dir), ["o_orderkey"])
    return diff.withColumn("changed", F.array_join("changed", ","))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of the orders over three versions, the last of which has all of them."""
    orders = read_table(spark, sf_dir, "orders")
    versions = [*_order_versions(spark, sf_dir), orders]
    named = [df.withColumn("snapshot", F.lit(f"v{k}")) for k, df in enumerate(versions, start=1)]
    return snapshots.key_history(named[0].unionByName(named[1]).unionByName(named[2]), ["o_orderkey"], "snapshot")


def key_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with the status that their order had in the second version."""
    lines = read_table(spark, sf_dir, "lineitem").withColumn("asked", F.lit("v2"))
    lines = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "asked")
    history = _history(spark, sf_dir).select("o_orderkey", "o_orderstatus", "valid_from", "valid_to")
    return snapshots.as_of(lines, history, ["o_orderkey"], "asked")


def read_newest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/snapshots_{uuid4().hex}"
    versions = ("2025-05-01", "2025-05-02_v2")
    for version, orders in zip(versions, _order_versions(spark, sf_dir), strict=True):
        write_snapshot(orders, root, "orders", version)
    return read_snapshot(spark, root, "orders", SCHEMAS["orders"])


def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between two stored versions of the orders, from their buckets that differ."""
    orders = read_table(spark, sf_dir, "orders")
    dear = F.when(F.col("o_totalprice") > 495000, "X").otherwise(F.col("o_orderstatus"))
    old, new = orders.filter("o_totalprice >= 2000"), orders.filter("o_totalprice <= 498000")
    root = f"{shared_dir(spark)}/hashed_{uuid4().hex}"
    write_hashed(old, root, "orders", "v1", ["o_orderkey"])
    write_hashed(new.withColumn("o_orderstatus", dear), root, "orders", "v2", ["o_orderkey"])
    rows = changed_in_buckets(spark, root, "orders", SCHEMAS["orders"], ["o_orderkey"], "v1", "v2")
    return rows.withColumn("changed", F.array_join("changed", ","))


def staged_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [
        ("log", lambda t: search_log(t["events"], ("search", "detail"))),
        ("entries", lambda t: behaviour.detail_entry(t["log"], WITHIN)),
        (
            "rates",
            lambda t: t["entries"]
            .groupBy("result_count")
            .agg(F.count(F.lit(1)).alias("searches"), F.count_if("entered").alias("entered")),
        ),
    ]
    out_dir = f"{shared_dir(spark)}/stages_{uuid4().hex}"
    return run_stages(spark, stages, _tables(spark, sf_dir, "events"), out_dir)["rates"]


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_fingerprint(_fixed_text(read_table(spark, sf_dir, "lineitem")))


def _llm() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """Queries and SQL of the subpackage `llm` and its pipeline, if they are there."""
    # Only what is not there is left out; an error within it is an error.
    if not all(map(importlib.util.find_spec, ("corpus_pipeline", "seektrail.llm"))):
        return {}, {}
    import corpus_pipeline
    from seektrail.llm import queries as llm

    found = {query.__name__: query for query in llm.QUERIES} | {"pipeline": corpus_pipeline.run}
    sql = dict(llm.ORACLE_SQL)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


QUERIES = (
    no_result_rate,
    re_search,
    condition_change,
    detail_entry,
    search_sessions,
    transitions,
    session_paths,
    no_result_recovery,
    detail_attribution,
    no_result_conditions,
    behaviour_rollup,
    behaviour_cube,
    daily_trend,
    rolling_users,
    frequent_sequences,
    time_to_detail,
    compare_groups,
    clustered_comparison,
    pattern_matches,
    journey_patterns,
    quality_report,
    row_rules,
    duplicate_keys,
    minimal_keys,
    dependencies,
    orphans,
    time_order,
    quarantine_valid,
    quarantine_rejected,
    pseudonymize,
    pii_scan,
    pii_mask,
    pii_report,
    anonymous_classes,
    anonymity_before_and_after,
    column_profile,
    referential_subset,
    referential_subset_orders,
    broken_references,
    subset_of_people,
    sample_drift,
    dictionary,
    dictionary_encode,
    dictionary_decode,
    table_differences,
    latest,
    snapshot_diff,
    key_history,
    as_of,
    read_newest_snapshot,
    changed_rows,
    staged_analysis,
    fingerprint,
)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: the rate of searches without results per day."""
    return no_result_rate(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES} | _llm()[0]


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL per query, from `oracles/<name>.sql`."""
    folder = Path(__file__).parent / "oracles"
    own = {q.__name__: (folder / f"{q.__name__}.sql").read_text() for q in QUERIES}
    return own | _llm()[1]

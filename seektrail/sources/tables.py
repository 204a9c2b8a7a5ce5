"""Reading the input tables and shaping them into a search log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seektrail.sources.model import SCHEMAS

# Which `events.event_type` values stand for which kind of search-log event (fixed values). All
# that are not listed, null included, are of kind `other`.
EVENT_TYPES = {"search": ("view", "error"), "detail": ("click",)}
KINDS = (*EVENT_TYPES, "other")


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Read `<directory>/<name>.parquet` with its declared schema, so nothing is inferred."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


def search_log(events: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """The `events` table as a search log holding only the given kinds.

    The kinds are filtered on `event_type` itself: a filter on the derived `kind` would not
    reach the Parquet scan.
    """
    event_type = F.col("event_type")
    if "other" not in kinds:
        events = events.filter(event_type.isin([t for k in kinds for t in EVENT_TYPES[k]]))
    elif unwanted := [t for k, types in EVENT_TYPES.items() if k not in kinds for t in types]:
        events = events.filter(event_type.isNull() | ~event_type.isin(unwanted))
    k = F.get_json_object("props", "$.k").try_cast("int")
    return events.select(
        "event_id",
        "ts",
        "user_id",
        F.when(event_type.isin(*EVENT_TYPES["search"]), "search")
        .when(event_type.isin(*EVENT_TYPES["detail"]), "detail")
        .otherwise("other")
        .alias("kind"),
        F.when(event_type == "view", 1).when(event_type == "error", 0).alias("result_count"),
        F.create_map(
            F.lit("area"),
            F.floor(k / 10).cast("string"),
            F.lit("price"),
            (k % 10).cast("string"),
        ).alias("cond"),
    )

"""Column expressions on search conditions and steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def changed_fields(old: Column, new: Column) -> Column:
    """Sorted names of the fields whose values differ, null-safe, between two condition maps."""
    old, new = (F.coalesce(c, F.create_map().cast("map<string,string>")) for c in (old, new))
    fields = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.array_sort(
        F.filter(
            fields,
            lambda f: (F.map_contains_key(old, f) != F.map_contains_key(new, f))
            | ~F.try_element_at(old, f).eqNullSafe(F.try_element_at(new, f)),
        )
    )


def is_search() -> Column:
    return F.col("kind") == "search"


def no_result() -> Column:
    return is_search() & (F.col("result_count") == 0)


def step() -> Column:
    """The kind of an event, with searches that found nothing told apart as `no_result`."""
    return F.when(no_result(), "no_result").otherwise(F.col("kind"))

"""Frequent subsequences against brute force."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from seektrail.operators.sequences import frequent_sequences

SCHEMA = "user int, at int, no int, what string"


def holds(items, pattern):
    """items: (place, item)."""
    last = None
    for wanted in pattern:
        later = [p for p, i in items if i == wanted and (last is None or p > last)]
        if not later:
            return False
        last = min(later)
    return True


def plain(rows, share, longest):
    sequences = {}
    for user, at, no, what in rows:
        if None not in (user, at, no, what):
            sequences.setdefault(user, []).append(((at, no), what))
    items = sorted({i for s in sequences.values() for _, i in s})
    out = {}
    for length in range(1, longest + 1):
        for pattern in product(items, repeat=length):
            support = sum(holds(s, pattern) for s in sequences.values())
            if support and support >= share * len(sequences) - 1e-9:
                out[pattern] = (length, support)
    return out


def found(df):
    return {tuple(r["pattern"]): (r["length"], r["support"]) for r in df.collect()}


@pytest.mark.parametrize("share, longest", [(0.3, 3), (0.6, 4), (1.0, 2), (0.01, 2)])
def test_patterns_are_those_of_brute_force(spark, share, longest):
    random = np.random.default_rng(5)
    rows = [
        (int(random.integers(12)), int(random.integers(30)), int(random.integers(2)), "abcde"[random.integers(5)])
        for _ in range(160)
    ]
    # A sequence with most of the rows, and rows that are left out.
    rows += [(99, k // 3, 0, "abc"[k % 3]) for k in range(400)]
    rows += [(None, 1, 1, "a"), (1, None, 1, "b"), (1, 2, 3, None), *rows[:20]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert found(frequent_sequences(df, "user", ["at", "no"], F.col("what"), share, longest)) == plain(rows, share, longest)


def test_no_rows_and_wrong_limits(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert frequent_sequences(df, "user", ["at"], F.col("what"), 0.5, 3).collect() == []
    for share, longest in ((0, 2), (1.5, 2), (0.5, 0)):
        with pytest.raises(ValueError):
            frequent_sequences(df, "user", ["at"], F.col("what"), share, longest)

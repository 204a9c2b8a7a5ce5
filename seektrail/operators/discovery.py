"""Discovering the keys of a table and the dependencies between its columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seektrail.functions.hashing import PLAIN_TYPES, as_text
from seektrail.plans.hot import stored

RESULT = "columns array<string>, determines array<string>"
# About so many rows are looked at per set of columns before all rows are; tables of twice as many are sliced.
SLICE_ROWS = 1_000_000
# Sets that one job looks at: the driver keeps a plan of all of them, anew for each stage that ends.
SETS_PER_JOB = 10


def minimal_keys(df: DataFrame, columns: Sequence[str] | None = None, largest: int = 3) -> DataFrame:
    """The sets of up to `largest` columns whose values are no two rows', and none of whose subsets are.

    Returns `columns`, each set in the table's order; a table of one row has the empty set as its key,
    an empty table has no keys. Nulls are equal to each other, as in grouping, and so are 0.0 and -0.0. Runs jobs
    while it is called, in which `df` is read once, and again for each set of which slices do not refute everything:
    store it first if it is dear to compute. See `_Lattice`.
    """
    lattice = _Lattice(df, columns, largest)
    for level in range(1, largest + 1):
        lattice.check_level(level, determined=False)
    keys = [(lattice.in_order(key), None) for key in lattice.keys]
    return df.sparkSession.createDataFrame(keys, RESULT).select("columns")


def dependencies(df: DataFrame, columns: Sequence[str] | None = None, largest: int = 2) -> DataFrame:
    """Which column's value follows from those of up to `largest` other columns.

    Returns `columns` (the set, in the table's order) and `determines`, in which rows are equal that are equal
    in the set. Only sets of which no part determines the column are
    returned, and none that hold a key, which determine everything. A constant column follows from
    the empty set. An empty table has no dependencies, nor has one of a single row, whose key is the
    empty set. Nulls are equal to each other, as in grouping. Runs jobs while called, as `minimal_keys` does.
    """
    lattice = _Lattice(df, columns, largest)
    for level in range(largest + 1):
        lattice.check_level(level)
    found = [(lattice.in_order(s), [c]) for s, c in lattice.dependencies]
    table = df.sparkSession.createDataFrame(found, RESULT)
    return table.select("columns", F.col("determines")[0].alias("determines"))


class _Lattice:
    """Claims about ever larger sets of columns: no two rows are equal in a set, or all that are have one value.

    Two rows refute a claim, wherever they are found. So a large table is read once for its slices, which are
    stored: a slice per column, of the rows whose value's hash divides evenly by the number of slices. About
    SLICE_ROWS rows are expected in each, less if frequent values are not in it. A set is first looked at in the slice of
    one of its columns, where rows equal in the set are together or not at all, or in another slice if those are
    all small. Only what this does not refute is looked at in all rows, and nothing holds that was not.
    A look is one aggregation by the set's columns, combined within tasks
    before it is shuffled, so frequent values do not weigh on it; one row per set comes back. Sets that hold
    a key are not looked at, nor are those that hold a column which follows from others of the set.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str] | None, largest: int):
        if largest < 1:
            raise ValueError(f"sets have at least one column: {largest}")
        self.columns = list(columns or df.columns)
        self.kinds = dict(df.select(*self.columns).dtypes)
        self.names = {c: f"__by{i}" for i, c in enumerate(self.columns)}
        self.all = df.select(*[_narrow(c, self.kinds[c]).alias(n) for c, n in self.names.items()])
        self.rows = df.count()
        self.slices = self._sliced(self.rows // SLICE_ROWS)
        self.keys: list[frozenset[str]] = [frozenset()] if self.rows == 1 else []
        self.dependencies: list[tuple[frozenset[str], str]] = []

    def in_order(self, columns: frozenset[str]) -> list[str]:
        return [c for c in self.columns if c in columns]

    def check_level(self, level: int, determined: bool = True) -> None:
        """Look for keys of `level` columns and, if wanted, for what such sets determine."""
        if not self.rows:
            return
        claims = {}
        for columns in map(frozenset, combinations(self.columns, level)):
            if self._holds_key(columns) or self._reduces(columns):
                continue
            others = [c for c in self.columns if determined and c not in columns and not self._follows(columns, c)]
            claims[columns] = (True, others)
        if self.slices:
            claims = self._unrefuted(claims, {s: self._slice_for(s) for s in claims})
        for columns, (is_key, others) in self._unrefuted(claims, dict.fromkeys(claims, self.all)).items():
            if is_key:
                self.keys.append(columns)
            else:
                self.dependencies += [(columns, c) for c in others]

    def _holds_key(self, columns: frozenset[str]) -> bool:
        return any(key <= columns for key in self.keys)

    def _follows(self, columns: frozenset[str], column: str) -> bool:
        return any(c == column and smaller <= columns for smaller, c in self.dependencies)

    def _reduces(self, columns: frozenset[str]) -> bool:
        """Whether one of the columns follows from the others."""
        return any(self._follows(columns - {c}, c) for c in columns)

    def _sliced(self, slices: int) -> dict[str, tuple[int, DataFrame]]:
        """The slices that hold rows, with their number, by column. A row is in a slice once at most."""
        if slices < 2:
            return {}
        # Hashed with its column's number, a value that many columns share is not in the slices of all of them.
        inside = [
            F.col(n).isNotNull() & (F.pmod(F.xxhash64(F.lit(k), n), F.lit(slices)) == 0)
            for k, n in enumerate(self.names.values())
        ]
        numbers = F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in enumerate(inside)]))
        rows = self.all.filter(reduce(Column.__or__, inside)).withColumn("__slice", F.explode(numbers))
        rows = stored(rows, "slices")
        sizes = {r["__slice"]: r["count"] for r in rows.groupBy("__slice").count().collect()}
        return {self.columns[k]: (size, rows.filter(F.col("__slice") == k)) for k, size in sizes.items()}

    def _slice_for(self, columns: frozenset[str]) -> DataFrame:
        """The slice nearest to SLICE_ROWS rows, of one of the columns if one of theirs has a tenth of that."""
        own = [self.slices[c] for c in self.in_order(columns) if c in self.slices]
        own = [s for s in own if s[0] >= SLICE_ROWS / 10]
        candidates = own or [self.slices[c] for c in self.columns if c in self.slices]
        return min(candidates, key=lambda s: abs(s[0] - SLICE_ROWS))[1]

    def _unrefuted(self, claims: dict, tables: dict) -> dict:
        """The claims per set, whether it is a key and what it determines, that the set's table does not refute."""
        sets = list(claims)
        checks = [self._check(k, tables[s], self.in_order(s), *claims[s]) for k, s in enumerate(sets)]
        left = {}
        jobs = [checks[k : k + SETS_PER_JOB] for k in range(0, len(checks), SETS_PER_JOB)]
        for row in (row for job in jobs for row in reduce(DataFrame.unionByName, job).collect()):
            is_key, others = claims[sets[row["set"]]]
            is_key = is_key and not row["repeated"]
            others = [c for c, broken in zip(others, row["broken"], strict=True) if not broken]
            if is_key or others:
                left[sets[row["set"]]] = (is_key, others)
        return left

    def _check(self, k: int, table: DataFrame, columns: list[str], is_key: bool, others: list[str]) -> DataFrame:
        """One row: `set`, whether it is `repeated`, and which claims on the other columns are `broken`."""
        names = [self.names[c] for c in columns]
        values = [_words(self.names[c], self.kinds[c]) for c in others]
        words = [w.alias(f"__{i}_{j}") for i, v in enumerate(values) for j, w in enumerate(v)]
        rows = table.select(*names, *words)
        ends = [f(w).alias(f"{w}_{f.__name__}") for w in rows.columns[len(names) :] for f in (F.min, F.max)]
        known = [F.count(f"__{i}_0").alias(f"__{i}_known") for i in range(len(others))]
        classes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__rows"), *ends, *known)
        broken = []
        for i, v in enumerate(values):
            differs = [F.col(f"__{i}_{j}_min") != F.col(f"__{i}_{j}_max") for j in range(len(v))]
            some_null = (F.col(f"__{i}_known") > 0) & (F.col(f"__{i}_known") < F.col("__rows"))
            broken.append(F.max(reduce(Column.__or__, differs, some_null)))
        return classes.agg(
            F.lit(k).alias("set"),
            F.coalesce(F.max(F.col("__rows") > 1), F.lit(False)).alias("repeated"),
            F.array(*[F.coalesce(b, F.lit(False)) for b in broken]).cast("array<boolean>").alias("broken"),
        )


def _is_plain(kind: str) -> bool:
    return kind in PLAIN_TYPES or kind.startswith("decimal")


def _narrow(column: str, kind: str) -> Column:
    """What rows are grouped by: numbers, dates and the like as they are, others in at most 16 bytes."""
    if kind in ("float", "double"):  # the two zeros are one value
        return F.col(column) + F.lit(0.0).cast(kind)
    if _is_plain(kind):
        return F.col(column)
    text = F.col(column) if kind == "string" else as_text(column, kind)
    # A short text cannot be taken for a digest, which has 16 bytes.
    return F.when(F.octet_length(text) < 16, text.cast("binary")).otherwise(F.unhex(F.md5(text)))


def _words(narrow: str, kind: str) -> list[Column]:
    """Columns of fixed width that are equal if the narrow values are: the value, or a digest of 128 bits."""
    value = F.col(narrow)
    if _is_plain(kind):
        return [value]
    return [F.when(value.isNotNull(), F.xxhash64(*seed, value)) for seed in ([], [F.lit(1)])]

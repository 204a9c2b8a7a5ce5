"""Near-duplicate documents by min-max hashing of word shingles, with exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seektrail.llm.common import in_groups, in_pieces, mix, packed, partitions, slices, unpacked, utf8
from seektrail.llm.components import components
from seektrail.llm.shingles import SHINGLE, shared, shingle_sets
from seektrail.plans.hot import stored

# Sixty hash evaluations give 120 values, which are cut into bands of equal size, as large as the
# threshold allows: a pair at it shares no band with a chance below this. At 0.85 that gives 24
# bands of 5, at 0.80 30 of 4.
HASHES = 60
MISSED = 1e-6
# Pairs are compared in full unless their signatures differ by more than five standard deviations
# from what the threshold would give.
DEVIATIONS = 5
# Members or bytes of a group above which its pairs are dealt to several tasks.
BLOCK_ROWS = 4_000
BLOCK_BYTES = 16 << 20

_TIMES = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_PLUS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def signatures(hashes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The smallest and the largest value of every hash function per set (none may be empty)."""
    out = np.empty((len(limits) - 1, 2 * HASHES), np.uint32)
    if len(out):
        for k in range(HASHES):
            values = ((hashes * _TIMES[k] + _PLUS[k]) >> np.uint64(32)).astype(np.uint32)
            out[:, 2 * k] = np.minimum.reduceat(values, limits[:-1])
            out[:, 2 * k + 1] = np.maximum.reduceat(values, limits[:-1])
    return out


def band_count(percent: int) -> int:
    """The fewest bands that miss under `MISSED` of the pairs that overlap by `percent`."""
    values = 2 * HASHES
    for rows in range(values, 1, -1):
        if values % rows == 0 and (1 - (percent / 100) ** rows) ** (values // rows) < MISSED:
            return values // rows
    return values


def bands(signature: np.ndarray, count: int) -> np.ndarray:
    """One 64-bit key per band and set."""
    keys = np.empty((len(signature), count), np.uint64)
    rows = signature.shape[1] // count
    for band in range(count):
        key = np.full(len(signature), band, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            key = mix(key + signature[:, k] + np.uint64(0x9E3779B97F4A7C15))
        keys[:, band] = key
    return keys


def _fixed(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    return pa.array([row.tobytes() for row in values], pa.binary())


def _describe(size: int, count: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text"):
            hashes, limits = shingle_sets(*utf8(piece["text"]), size)
            sizes = np.diff(limits)
            some = np.flatnonzero(sizes)
            signature = np.zeros((len(sizes), 2 * HASHES), np.uint32)
            signature[some] = signatures(hashes, np.append(limits[:-1][some], len(hashes)))
            total = np.concatenate([[0], np.cumsum(hashes)]).astype(np.uint64)
            other = np.concatenate([[0], np.cumsum(mix(hashes))]).astype(np.uint64)
            keys = bands(signature, count).view(np.int64)
            yield pa.record_batch(
                {
                    "doc_id": piece["doc_id"],
                    "h": piece["h"],
                    "n": pa.array(sizes, pa.int64()),
                    "d1": pa.array((total[limits[1:]] - total[limits[:-1]]).view(np.int64)),
                    "d2": pa.array((other[limits[1:]] - other[limits[:-1]]).view(np.int64)),
                    "keys": pa.ListArray.from_arrays(
                        np.arange(0, keys.size + 1, count, dtype=np.int32), keys.ravel()
                    ),
                    "sketch": _fixed(signature.astype(np.uint8)),
                }
            )

    return describe


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for a shuffle."""
    for batch in slices(batches):
        sizes, values = packed(batch["text"])
        columns = {c: batch[c] for c in ("doc_id", "h")}
        yield pa.record_batch(columns | {"size": sizes, "packed": values})


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for piece in in_pieces([unpacked(batch)], "text"):
                hashes, limits = shingle_sets(*utf8(piece["text"]), size)
                sets = [hashes[a:b].tobytes() for a, b in zip(limits[:-1], limits[1:], strict=True)]
                columns = {c: piece[c] for c in ("id", "key", "parts", "n", "sketch")}
                yield pa.record_batch(
                    columns | {"n": pa.array(np.diff(limits)), "hashes": pa.array(sets, pa.binary())}
                )

    return sets


class _Roots:
    """Union-find over positions; the root is the smallest position."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def unite(self, x: int, y: int) -> None:
        a, b = self.of[x], self.of[y]
        if a != b:
            self.of[self.of == max(a, b)] = min(a, b)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    flat = b"".join(table[column].to_pylist())
    return np.frombuffer(flat, np.uint8).reshape(table.num_rows, -1)


def _spanning(table: pa.Table, percent: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components among the rows of one group.

    With `side`, only pairs of different sides are looked at, otherwise all pairs.
    """
    order = np.argsort(table["id"].to_numpy(), kind="stable")
    table = table.take(order)
    ids, n = table["id"].to_numpy(), table["n"].to_numpy()
    side, sketch = table["side"].to_numpy(), _matrix(table, "sketch")
    share, width = percent / 100, sketch.shape[1]
    # A hash function's smallest and largest value agree independently, or nearly so.
    least = width * share - DEVIATIONS * np.sqrt(width * share * (1 - share))
    hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()] if exact else None
    roots, two_sides = _Roots(len(ids)), bool(side.any())
    for x in range(1, len(ids)):
        fits = (100 * np.minimum(n[:x], n[x]) >= percent * np.maximum(n[:x], n[x])) & (
            roots.of[:x] != roots.of[x]
        )
        if two_sides:
            fits &= side[:x] != side[x]
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        alike = (sketch[at] == sketch[x]).sum(axis=1)
        likely = alike >= least
        at = at[likely][np.argsort(-alike[likely], kind="stable")]
        for y in at.tolist():
            if roots.of[y] == roots.of[x]:
                continue
            if exact:
                both = shared(hashes[x], hashes[y])
                if 100 * both < percent * (n[x] + n[y] - both):
                    continue
            roots.unite(x, y)
    linked = np.flatnonzero(roots.of != np.arange(len(ids)))
    return ids[linked], ids[roots.of[linked]]


def _links(percent: int, exact: bool):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, ["key", "i", "j"]):
            a, b = _spanning(table, percent, exact)
            if len(a):
                yield pa.record_batch({"a": pa.array(a), "b": pa.array(b)})

    return links


def _compare(members: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links among the members (id, n, sketch, hashes if exact) of one `key`.

    `parts` says how many parts a key has. Every pair of parts meets in a task of its own, so a
    large group is not one task's work.
    """
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = (
        members.withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("i", F.least("part", "other"))
        .withColumn("j", F.greatest("part", "other"))
        .withColumn(
            "side",
            F.when(F.col("part") == F.col("other"), 0)
            .when(F.col("part") < F.col("other"), 1)
            .otherwise(2),
        )
        .drop("part", "other", "parts")
    )
    return (
        dealt.repartition(partitions(members), "key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(_links(percent, exact), "a bigint, b bigint")
    )


def near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    size: int = SHINGLE,
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Components of documents whose shingle sets overlap by at least `percent` of their union.

    `docs` has doc_id (long) and text; other columns are ignored. Returns, per input row, doc_id,
    n_shingles, component_id (smallest doc_id reachable) and kept (the row is its component's
    smallest doc_id).

    Words are runs of anything but space and tab to carriage return, A-Z lower-cased. A document
    with fewer than `size` words is one shingle; one without words, or a null text, has none and
    is linked with nothing. Rows with equal sets are one node, however many there are. A null
    doc_id takes no part: component_id is null, the row is kept. Repeated rows have equal results,
    all kept or none. Rows that share a doc_id but not the text are documents of their own. An
    empty table gives an empty result.

    Sets that share a band (see `band_count`) of their min-max signatures and whose signatures agree
    well enough form candidate groups; each candidate's whole set goes once to its group, where
    links are confirmed on whole sets. Groups above `block_rows` or `block_bytes` are dealt out by
    pairs of parts. Nothing is capped. Runs jobs while it is called.
    """
    described, found = _found(docs, percent, size, block_rows, block_bytes)
    joined = described.join(found, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame,
    percent: int = 85,
    size: int = SHINGLE,
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of `docs`, all columns, without near-duplicates: one row of each component stays.

    Components are those of `near_duplicates`. The row with the smallest doc_id stays; of rows that
    share it, one with the fewest shingles. Rows are told apart by doc_id and text, so a document
    stays if only another one of its doc_id is a duplicate. Rows that repeat both are one document:
    one of them stays. A null doc_id takes no part, documents without words are no duplicates. An
    empty table gives an empty result. Runs jobs while it is called.
    """
    described, found = _found(docs, percent, size, block_rows, block_bytes)
    once = described.dropDuplicates(["doc_id", "h"]).filter("doc_id is not null and n > 0")
    linked = once.join(found, ["n", "d1", "d2"])
    stays = F.struct("doc_id", "n", "h")
    best = linked.groupBy("component").agg(F.min(stays).alias("stays"))
    gone = linked.join(best, "component").filter(stays != F.col("stays"))
    gone = stored(gone.select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")), "gone")
    h = F.xxhash64(F.col("text").cast("string"))
    left = docs.join(gone, (docs["doc_id"] == gone["__id"]) & (h == gone["__h"]), "left_anti")
    again = described.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h"))
    again = stored(again.agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "again")
    if again.isEmpty():
        return left
    # Only the rows that are there several times are brought together.
    same = docs["doc_id"].eqNullSafe(again["__id"]) & (h == again["__h"])
    one = left.join(again, same, "left_semi").withColumn("__h", h).dropDuplicates(["doc_id", "__h"])
    return left.join(again, same, "left_anti").unionByName(one.drop("__h"))


def _found(docs: DataFrame, percent: int, size: int, block_rows: int, block_bytes: int):
    """doc_id, n, d1, d2 and h (hash of the text) per row, and of each set (n, d1, d2) with a doc_id
    its `component` (a number) and component_id."""
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    texts = texts.withColumn("h", F.xxhash64("text"))
    described = stored(
        texts.mapInArrow(
            _describe(size, band_count(percent)),
            "doc_id bigint, h bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>, sketch binary",
        ),
        "described",
    )
    digest = ["n", "d1", "d2"]
    # Rows with equal sets are one node. Its number is its own: rows may share a doc_id.
    sketched = stored(
        described.filter("n > 0 and doc_id is not null")
        .groupBy(*digest)
        .agg(F.min(F.struct("doc_id", "h")).alias("r"), F.min(F.struct("keys", "sketch")).alias("s"))
        .select(F.monotonically_increasing_id().alias("id"), *digest, "r.*", "s.keys", "s.sketch"),
        "sketched",
    )
    keyed = sketched.select("id", F.explode("keys").alias("key"))
    parts = F.ceil(F.col("rows") / block_rows).cast("int")
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # Stored, so that both sides of the join are shuffled for it and Spark can split a hot key.
    counts = stored(counts.select("key", parts.alias("parts")), "counts")
    members = keyed.join(counts, "key")
    members = members.join(sketched.select("id", "n", "sketch"), "id")
    groups = stored(
        components(_compare(members, percent, False))
        .withColumnRenamed("component", "key")
        .join(sketched.select("id", "doc_id", "h", "n", "sketch"), "id"),
        "groups",
    )
    volume = groups.groupBy("key").agg(F.sum(8 * F.col("n") + 200).alias("bytes"))
    parts = F.ceil(F.col("bytes") / block_bytes).cast("int")
    groups = groups.join(volume.select("key", parts.alias("parts")), "key")
    whole = texts.filter("doc_id is not null").mapInArrow(
        _packed, "doc_id bigint, h bigint, size bigint, packed binary"
    )
    sets = whole.join(groups, ["doc_id", "h"]).mapInArrow(
        _sets(size), "id bigint, key bigint, parts int, n bigint, sketch binary, hashes binary"
    )
    linked = components(_compare(sets, percent, True))
    nodes = sketched.join(linked, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = nodes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = nodes.join(least, "component").select(*digest, "component", "component_id")
    return described.drop("keys", "sketch"), stored(found, "components")

"""Approximate nearest neighbours by inner product, along shifted Hilbert curves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seektrail.llm.common import in_groups, partitions
from seektrail.plans.hot import stored

NEIGHBOURS = 20
CURVES = 8
# Projected coordinates of a curve, and bits of each; a key has their product of bits.
AXES = 6
BITS = 10
# Vectors of a curve that make one block.
BLOCK = 1_024
# Bytes of neighbouring blocks that a task takes together, and vectors that it compares queries with at once.
STRIP_BYTES = 32 << 20
_VECTORS = 8_192
# Numbers of vectors that are gathered at once for exact scores.
_GATHERED = 1 << 22
# Queries that the window width is measured on, and the share of their true neighbours it must reach.
SAMPLE = 128
RECALL = 0.97


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points with whole coordinates below 2^bits (n x axes)."""
    x = points.T.astype(np.int64).copy()
    axes, q = len(x), 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.asarray(pc.list_flatten(table["embedding"]), np.float64).reshape(table.num_rows, -1)


def _keys(axes: int, bits: int, curves: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch)
            vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            size = vectors.shape[1]
            for curve in range(curves):
                random = np.random.default_rng(1_000 + curve)
                turned = np.linalg.qr(random.normal(size=(size, min(axes, size))))[0]
                # Four standard deviations to either side of the middle take three quarters of
                # an axis; the shift, another one for every axis and curve, the rest.
                unit = vectors @ turned * np.sqrt(size) / 8 + 0.5
                unit = unit.clip(0, 1) * 0.75 + 0.25 * random.random(turned.shape[1])
                points = np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1)
                yield pa.record_batch(
                    {
                        "curve": pa.array(np.full(batch.num_rows, curve, np.int32)),
                        "key": pa.array(hilbert_keys(points, bits)),
                        "rep": batch["rep"],
                    }
                )

    return keys


def _best(scores: np.ndarray, ids: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` highest scores, ties to smaller ids."""
    if len(scores) > 4 * count:
        bound = np.partition(scores, len(scores) - count)[len(scores) - count]
        near = np.flatnonzero(scores >= bound)
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:count]
    return scores[order], ids[order]


def _rough(vectors: np.ndarray) -> tuple[np.ndarray, float]:
    """The vectors as 32-bit floats, as shares of the length of the longest one; and that length."""
    longest = np.linalg.norm(vectors, axis=1).max()
    return (vectors / longest).astype(np.float32), longest


def _nearest_of(
    queries: np.ndarray, vectors: np.ndarray, rough: np.ndarray, longest: float, ids: np.ndarray, count: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query its `count` nearest vectors: rows of the queries, ascending, ids and scores.

    Products of the rough vectors cost half as much and tell which vectors may be near; these get exact scores.
    Where they are too many, as among vectors that hardly differ, exact products of all take their place.
    """
    lengths = np.linalg.norm(queries, axis=1, keepdims=True)
    asked = (queries / lengths).astype(np.float32)
    # Over twice what such a product of two lengths of 1 at most can be off.
    off = vectors.shape[1] * 2.0**-21
    rows, names, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    # What the product of a vector must reach for it to be among the nearest so far.
    bound = np.full((len(queries), 1), -np.inf, np.float32)
    for k in range(0, len(vectors), _VECTORS):
        others = vectors[k : k + _VECTORS]
        products = asked @ rough[k : k + _VECTORS].T
        if not k and products.shape[1] > count:
            # The first of them give a bound that is low, but no other needs to be sorted for it.
            bound = np.partition(products[:, : max(count, _VECTORS // 4)], -count, axis=1)[:, [-count]] - off
        near = np.flatnonzero(~(products < bound))
        many = len(near) * others.shape[1] > _GATHERED
        if many:
            products = queries @ others.T
            least = np.partition(products, -count, axis=1)[:, [-count]] if len(others) > count else -np.inf
            near = np.flatnonzero(products >= least)
        row, column = np.divmod(near, len(others))
        exact = products[row, column] if many else np.einsum("ij,ij->i", queries[row], others[column])
        rows = np.concatenate([rows, row])
        names = np.concatenate([names, ids[k + column]])
        scores = np.concatenate([scores, exact])
        order = np.lexsort((names, -scores, rows))
        rows, names, scores = rows[order], names[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        last = place == count - 1
        bound[rows[last], 0] = scores[last] / (lengths[rows[last], 0] * longest) - off
        rows, names, scores = rows[place < count], names[place < count], scores[place < count]
    return rows, names, scores


def _lists(queries: np.ndarray, rows: np.ndarray, names: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    limits = pa.array(np.searchsorted(rows, np.arange(len(queries) + 1)), pa.int32())
    return pa.record_batch(
        {
            "query": pa.array(queries, pa.int64()),
            "ids": pa.ListArray.from_arrays(limits, pa.array(names, pa.int64())),
            "scores": pa.ListArray.from_arrays(limits, pa.array(scores)),
        }
    )


_LISTS = "query bigint, ids array<bigint>, scores array<double>"


def _exact(sample: np.ndarray, vectors: np.ndarray, count: int):
    """The nearest of each batch to every sampled query."""

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                others, ids = _matrix(batch), batch["rep"].to_numpy()
                yield _lists(sample, *_nearest_of(vectors, others, *_rough(others), ids, count))

    return exact


def _search(count: int, radius: int):
    """The nearest of each strip to every query, from the blocks within the radius of its own.

    A strip's rows are sorted by `ask` and `block`, so the blocks that a query looks at are side by side.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, ["curve", "strip"]):
            asks = table["ask"].to_numpy()
            queries, others = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
            if not queries.num_rows or not others.num_rows:
                continue
            ids, vectors, blocks = others["rep"].to_numpy(), _matrix(others), others["block"].to_numpy()
            names, asked = queries["rep"].to_numpy(), _matrix(queries)
            rough, longest = _rough(vectors)
            own, starts = np.unique(queries["block"].to_numpy(), return_index=True)
            for block, a, b in zip(own, starts, [*starts[1:], len(names)], strict=True):
                near = slice(*np.searchsorted(blocks, [block - radius, block + radius + 1]))
                for k in range(a, b, 256):
                    some = slice(k, min(k + 256, b))
                    found = _nearest_of(asked[some], vectors[near], rough[near], longest, ids[near], count)
                    yield _lists(names[some], *found)

    return search


def _merge(count: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, ["query"]):
            ids = np.asarray(pc.list_flatten(table["ids"]), np.int64)
            scores = np.asarray(pc.list_flatten(table["scores"]), np.float64)
            ids, first = np.unique(ids, return_index=True)
            scores, ids = _best(scores[first], ids, count)
            yield pa.record_batch(
                {
                    "query": pa.array(np.full(len(ids), table["query"][0].as_py())),
                    "rep": pa.array(ids),
                    "score": pa.array(scores),
                }
            )

    return merge


def _merged(lists: DataFrame, count: int) -> DataFrame:
    return (
        lists.repartition(partitions(lists), "query")
        .sortWithinPartitions("query")
        .mapInArrow(_merge(count), "query bigint, rep bigint, score double")
    )


def nearest(
    vectors: DataFrame,
    asks: str = "vec_id % 20 = 0",
    count: int = NEIGHBOURS,
    curves: int = CURVES,
    block: int = BLOCK,
    recall: float = RECALL,
    sample: int = SAMPLE,
) -> DataFrame:
    """For each row that `asks` selects, its nearest others: query_id, rank, vec_id, score.

    `vectors` has vec_id (long) and embedding (array of float or double); other columns are ignored.
    Nearest is the largest inner product in double precision, ties to the smaller vec_id. Vectors
    that are null, zero, or hold a null or non-finite component take no part, neither do rows
    with a null vec_id nor vectors of another length than most have (the longest of these if several
    lengths are as frequent). Repeated rows count once. Fewer candidates than `count` are all
    returned; an empty table gives an empty result.

    Equal vectors are one point that carries the smallest `count` + 1 of its ids, which is all a result
    can use. Every curve orders all points by the Hilbert key of a random projection with a shift of
    its own, is range-partitioned on it and cut into blocks of `block` points. A query looks at its block
    and those within a radius on every curve; the lists are merged and reranked by the exact measure.
    The radius is the smallest that reaches `recall` of the true neighbours of `sample` queries, found by
    comparing those with all points. Where no order of the points brings neighbours together,
    as with evenly spread vectors of many dimensions, it widens up to all blocks. Runs jobs while called.
    """
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.filter(
        e.isNotNull() & F.col("vec_id").isNotNull() & sound & F.exists(e, lambda x: x != 0)
    )
    asking = F.coalesce(F.expr(asks), F.lit(False)).alias("asks")
    # Equal vectors meet by their hash first, as sorting by a number is cheap.
    usable = usable.select("vec_id", "embedding", asking, F.xxhash64(e).alias("hash"), F.size(e).alias("n"))
    usable = stored(usable, "usable")
    lengths = usable.groupBy("n").agg(F.count(F.lit(1)).alias("rows"))
    common = lengths.orderBy(F.desc("rows"), F.desc("n")).first()
    usable = usable.filter(F.col("n") == (common["n"] if common else 0))
    classes = usable.groupBy("hash", "embedding").agg(
        F.min("vec_id").alias("rep"), F.max("asks").alias("asked"), F.count(F.lit(1)).alias("rows")
    )
    points = stored(classes, "points")
    # Only rows of repeated vectors have to be joined with them.
    repeated = stored(points.filter("rows > 1").select("hash", "embedding", "rep"), "repeated")
    copies = usable.join(repeated, ["hash", "embedding"]).select("rep", "vec_id", "asks").distinct()
    single = points.filter("rows = 1").select("rep", F.col("rep").alias("vec_id"), F.col("asked").alias("asks"))
    ids = stored(single.union(copies), "ids")
    points = points.select("rep", "asked", "embedding")
    total = points.count()
    tasks = max(1, min(partitions(points), total * curves // (8 * block)))
    # Stored, as the limits of the ranges are found on a sample, for which keys would be made twice.
    keys = stored(points.mapInArrow(_keys(AXES, BITS, curves), "curve int, key bigint, rep bigint"), "keys")
    order = ["curve", "key", "rep"]
    laid = keys.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    # A task's rows get rising numbers, so their order needs no window and no second shuffle.
    laid = stored(
        laid.select("curve", "rep", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")),
        "curves",
    )
    blocks = laid.groupBy("curve", "task").agg(
        F.min("at").alias("first"), F.ceil(F.count(F.lit(1)) / block).alias("blocks")
    )
    before = F.sum("blocks").over(Window.partitionBy("curve").orderBy("task")) - F.col("blocks")
    blocks = blocks.select("curve", "task", "first", before.alias("before"))
    within = F.floor((F.col("at") - F.col("first")) / block)
    # A row for each task of a curve.
    placed = laid.join(F.broadcast(blocks), ["curve", "task"])
    placed = stored(placed.select("curve", "rep", (F.col("before") + within).cast("int").alias("block")), "placed")
    top = count + 1
    # A fixed number of queries, to measure on.
    some = points.filter("asked").orderBy(F.xxhash64("rep")).limit(sample).collect()
    some_ids = np.array([r["rep"] for r in some], np.int64)
    some_vectors = np.array([r["embedding"] for r in some], np.float64)
    truth = _merged(points.mapInArrow(_exact(some_ids, some_vectors, top), _LISTS), top) if some else None
    radius = _radius(truth, placed, some_ids.tolist(), recall) if some else 0
    # Half the radius, so that a query goes to six strips of a curve at most, unless strips would be too large.
    width = max(1, min(radius // 2, STRIP_BYTES // (8 * block * max(1, common["n"] if common else 1))))
    strips = _strips(placed.join(points, "rep"), radius, width)
    lists = (
        strips.repartition(partitions(points), "curve", "strip")
        .sortWithinPartitions("curve", "strip", "ask", "block")
        .mapInArrow(_search(top, radius), _LISTS)
    )
    found = _merged(lists, top)
    # From points to rows: a point's smallest ids, its own query excepted.
    nth = F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))
    few = ids.select("rep", "vec_id").withColumn("nth", nth).filter(F.col("nth") <= top)
    members = found.join(few, "rep").select("query", "score", "vec_id")
    named = ids.filter("asks").select(F.col("rep").alias("query"), F.col("vec_id").alias("query_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= top)
    pairs = members.join(named, "query")
    pairs = pairs.filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        pairs.withColumn("rank", rank)
        .filter(F.col("rank") <= count)
        .select("query_id", "rank", "vec_id", "score")
    )


def _strips(placed: DataFrame, radius: int, width: int) -> DataFrame:
    """All points by strips of `width` blocks, and each query once for every strip that it reaches into."""

    def strip(block: Column) -> Column:
        return F.floor(block / width).cast("int")

    own = F.col("block")
    reach = F.sequence(strip(F.greatest(F.lit(0), own - radius)), strip(own + radius))
    columns = ["curve", "strip", "block", "rep", "ask", "embedding"]
    points = placed.withColumns({"strip": strip(own), "ask": F.lit(False)})
    queries = placed.filter("asked").withColumns({"strip": F.explode(reach), "ask": F.lit(True)})
    return points.select(*columns).union(queries.select(*columns))


def _radius(truth: DataFrame, placed: DataFrame, sample: list[int], recall: float) -> int:
    """The smallest number of blocks to either side that finds the wanted share of `truth`."""
    own = placed.filter(F.col("rep").isin(sample))
    own = own.select("curve", F.col("rep").alias("query"), F.col("block").alias("from"))
    # Both are of the sampled queries only: their neighbours, and their blocks on every curve.
    apart = (
        placed.join(F.broadcast(truth.select("query", "rep")), "rep")
        .join(F.broadcast(own), ["query", "curve"])
        .groupBy("query", "rep")
        .agg(F.min(F.abs(F.col("block") - F.col("from"))).alias("apart"))
    )
    counts = apart.groupBy("apart").agg(F.count(F.lit(1)).alias("rows")).orderBy("apart").collect()
    wanted, seen = recall * sum(r["rows"] for r in counts), 0
    for r in counts:
        seen += r["rows"]
        if seen >= wanted:
            return int(r["apart"])
    return 0

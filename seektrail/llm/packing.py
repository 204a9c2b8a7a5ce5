"""Packing documents into sequences by vector best-fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seektrail.llm.common import in_pieces
from seektrail.llm.tokens import Encoder
from seektrail.plans.hot import stored

# Pieces of one length that are numbered together in a task.
BUCKET_ROWS = 20_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold: tokens, pieces, and the sum of squared piece lengths.

    The squares stand for the cost of attention within documents. `weights` say how much each
    of the three counts when a sequence is chosen.
    """

    tokens: int = 2048
    pieces: int = 2048
    attention: int = 2048**2
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)


@dataclass(frozen=True)
class Plan:
    """Which ranks of which length go where. One entry per place of a length in a kind of sequence.

    The pieces of `length` ranked `rank` to `rank + sequences * each - 1` fill sequences from
    `sequence` on, `each` per sequence, side by side from `offset` on.
    """

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray
    sequences: int


def plan_packing(histogram: dict[int, int], capacity: Capacity, score: str = "norm") -> Plan:
    """Vector best-fit over a histogram of lengths, longest first.

    A piece goes to the open sequence, among those it fits under every capacity, that is left
    with the smallest weighted norm of its residuals (score "norm"), or whose residuals have the
    smallest weighted dot product with the piece's needs ("dot"); a new one is opened if it fits
    none. Sequences with equal contents are handled together, and as adding a piece only lowers
    either score, one sequence takes as many pieces of a length as fit before the next one does.
    So the result is that of going piece by piece, at the cost of a few steps per length.
    """
    limits = np.array([capacity.tokens, capacity.pieces, capacity.attention], float)
    weights = np.array(capacity.weights, float)
    # Open kinds of sequences: residuals, first sequence, how many.
    left = np.empty((0, 3))
    first = np.empty(0, np.int64)
    count = np.empty(0, np.int64)
    entries: list[tuple[int, int, int, int, int]] = []
    opened = 0
    shortest = min(histogram, default=0)
    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, length**2], float)
        rank, todo = 0, histogram[length]
        fit = np.floor(left / need).min(axis=1) if len(left) else np.empty(0)
        able = np.flatnonzero(fit >= 1)
        if score == "norm":
            value = (weights * ((left[able] - need) / limits) ** 2).sum(axis=1)
        else:
            value = (weights * (need / limits) * (left[able] / limits)).sum(axis=1)
        added = []
        for k in able[np.argsort(value, kind="stable")]:
            if not todo:
                break
            each = int(fit[k])
            whole = min(count[k], todo // each)
            rest = todo - whole * each if whole < count[k] else 0
            for sequences, n in ((whole, each), (1, rest)):
                if not sequences or not n:
                    continue
                offset = int(limits[0] - left[k, 0])
                entries.append((length, rank, first[k], offset, n))
                added.append((left[k] - n * need, first[k], sequences))
                first[k] += sequences
                count[k] -= sequences
                rank += sequences * n
                todo -= sequences * n
        each = int(np.floor(limits / need).min())
        if todo and not each:
            raise ValueError(f"a piece of {length} tokens exceeds the capacity of a sequence")
        for sequences, n in ((todo // each if todo else 0, each), (1, todo % each if todo else 0)):
            if sequences and n:
                entries.append((length, rank, opened, 0, n))
                added.append((limits - n * need, opened, sequences))
                opened += sequences
                rank += sequences * n
        if added:
            left = np.vstack([left, *(x[0] for x in added)])
            first = np.append(first, [x[1] for x in added]).astype(np.int64)
            count = np.append(count, [x[2] for x in added]).astype(np.int64)
        open_still = (count > 0) & (left[:, 0] >= shortest) & (left[:, 1] >= 1)
        left, first, count = left[open_still], first[open_still], count[open_still]
    columns = np.array(entries, np.int64).reshape(-1, 5)
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    return Plan(*columns.T, opened)


def _pieces(size: int, end: int, vocabulary: str | None):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in in_pieces(batches, "text"):
            rows: list[tuple[int, int, int, int, int]] = []
            for k, ids in enumerate(encoder.ids(batch["text"].to_pylist(), end)):
                short = len(ids) % size or size
                starts = [0, *range(short, len(ids), size)]
                for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    rows.append((k, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            k, piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"].take(pa.array(k)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array(crc),
                }
            )

    return pieces


def _seated(plan: Plan):
    # One ascending number for (length, rank); ranks stay far below 2^44.
    keys = (plan.length << 44) + plan.rank

    def seated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            nth = rank - plan.rank[at]
            each = plan.each[at]
            values = {c: batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            values["sequence_id"] = pa.array(plan.sequence[at] + nth // each)
            values["offset"] = pa.array(plan.offset[at] + nth % each * length)
            yield pa.record_batch(values)

    return seated


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pack(
    docs: DataFrame,
    capacity: Capacity = Capacity(),
    end: int = 0,
    score: str = "norm",
    vocabulary: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Pieces of all documents and where they go: sequence_id, and offset in it.

    `docs` has doc_id (long) and text; other columns are ignored. A document is its ids followed
    by `end`; a null or empty text is just `end`. One longer than a sequence is cut into pieces as
    long as a sequence, of which the first may be shorter. Rows that share a doc_id, null included,
    are packed as documents of their own. An empty table gives an empty result. A document of any
    length is encoded whole. Piece lengths that exceed the capacity's attention raise ValueError.

    As a piece's needs follow from its length, the plan is made from the histogram of lengths, which
    has at most `capacity.tokens` entries however many documents there are. Pieces of a length are
    ranked in buckets of about `bucket_rows`, so a length that many documents share is no
    single task. Runs jobs while it is called.
    """
    pieces = stored(
        docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
            _pieces(capacity.tokens, end, vocabulary), PIECES
        ),
        "pieces",
    )
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packing(counts, capacity, score)
    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets))
    dealt = pieces.withColumn("bucket", bucket)
    per_bucket = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    ordered = Window.partitionBy("length").orderBy("bucket")
    before = F.sum("n").over(ordered) - F.col("n")
    per_bucket = per_bucket.select("length", "bucket", before.alias("before"))
    own = F.row_number().over(
        Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    )
    ranked = dealt.withColumn("own", own).join(per_bucket, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own") - 1)
    return ranked.mapInArrow(_seated(plan), PIECES + ", sequence_id bigint, offset bigint")


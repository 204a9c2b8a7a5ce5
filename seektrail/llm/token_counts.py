"""Exact counts of tokens for any context limit, from a histogram of document lengths."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seektrail.llm.common import in_pieces
from seektrail.llm.tokens import Encoder
from seektrail.plans.hot import stored

# Lengths that one task sums up after the sums per bin are known.
BIN = 4_096


def _lengths(vocabulary: str | None):
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for piece in in_pieces(batches, "text"):
            sizes = [len(ids) for ids in encoder.ids(piece["text"].to_pylist())]
            values, counts = np.unique(np.array(sizes, np.int64), return_counts=True)
            yield pa.record_batch({"length": pa.array(values), "docs": pa.array(counts)})

    return lengths


def length_histogram(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Documents per encoded length, with sums over this and all greater lengths.

    `docs` has text; other columns are ignored. A null text has no tokens. Returns, for every
    length that occurs, docs, docs_at_least, tokens_at_least, and truncated_tokens: the corpus's
    tokens if every document is cut to that length. An empty table gives no rows.

    Texts are counted where they are read and only (length, documents) is shuffled, so repeated
    lengths are summed before. Suffix sums go over bins of lengths, then within each bin. Runs a job
    while it is called.
    """
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        _lengths(vocabulary), "length bigint, docs bigint"
    )
    tokens = F.col("length") * F.col("docs")
    table = counted.groupBy("length").agg(F.sum("docs").alias("docs"))
    # Stored: bins and sums would each encode all texts otherwise.
    table = stored(table.withColumn("bin", F.expr(f"length div {BIN}")), "lengths")
    bins = table.groupBy("bin").agg(F.sum("docs").alias("d"), F.sum(tokens).alias("t"))
    above = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        "bin",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("t").over(Window.partitionBy()).alias("all_tokens"),
    )
    here = Window.partitionBy("bin").orderBy(F.desc("length"))
    sums = table.join(bins, "bin").select(
        "length",
        "docs",
        (F.sum("docs").over(here) + F.col("docs_above")).alias("docs_at_least"),
        (F.sum(tokens).over(here) + F.col("tokens_above")).alias("tokens_at_least"),
        "all_tokens",
    )
    beyond = F.col("tokens_at_least") - F.col("length") * F.col("docs_at_least")
    return sums.select(
        "length",
        "docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("all_tokens") - beyond).alias("truncated_tokens"),
    )


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit: documents longer than it, and tokens if all are cut to it."""
    cut = [
        F.struct(
            F.lit(n).cast("bigint").alias("limit"),
            F.sum(F.when(F.col("length") > n, F.col("docs")).otherwise(0)).alias("docs_over"),
            F.sum(F.least(F.col("length"), F.lit(n)) * F.col("docs")).alias("tokens"),
        )
        for n in limits
    ]
    return histogram.agg(F.array(*cut).alias("all")).select(F.inline("all"))


def length_quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least a share of the documents does not exceed, per share."""
    total = histogram.agg(F.max("docs_at_least")).first()[0] or 0
    # Documents up to a length: all but those longer than it.
    upto = total - F.col("docs_at_least") + F.col("docs")
    return histogram.agg(
        F.array(
            *[
                F.struct(F.lit(p).alias("share"), F.min(F.when(upto >= p * total, F.col("length"))).alias("length"))
                for p in shares
            ]
        ).alias("all")
    ).select(F.inline("all"))

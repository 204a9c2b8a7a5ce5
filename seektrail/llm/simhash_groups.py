"""Near-duplicate documents by SimHash fingerprints and deletion variants of their segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seektrail.llm.common import in_groups, in_pieces, partitions, utf8
from seektrail.llm.components import components
from seektrail.plans.hot import stored

SHINGLE = 3
BITS = 64
SEED = 42
# The differing bits up to which fingerprints are linked. Two segments, one of which then differs in
# one bit at most.
DISTANCE = 2
SEGMENTS = 2
# Members of a group that one task compares. Larger groups are parted by variants of their other
# bits; after two such steps no group can hold more.
GROUP = 2_048
# Shingles that are hashed and counted by bit at once, and bytes of text that become arrays at once.
HASHED = 1 << 16
PIECE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _words(data: np.ndarray, limits: np.ndarray):
    """All words with one space after each, their starts and ends there, and the texts' limits."""
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = limits[(limits > 0) & (limits < len(data))]
    first[cuts], last[cuts - 1] = inside[cuts], inside[cuts - 1]
    kept = np.flatnonzero(inside)
    word = np.cumsum(first[kept]) - 1
    count = int(word[-1]) + 1 if len(word) else 0
    text = np.full(len(kept) + count, 32, np.uint8)
    text[np.arange(len(kept)) + word] = _LOWER[data[kept]]
    place = np.arange(count)
    starts = np.flatnonzero(first[kept]) + place
    ends = np.flatnonzero(last[kept]) + place + 1
    return text.tobytes(), starts, ends, np.searchsorted(np.flatnonzero(first), limits)


def fingerprints(data: np.ndarray, limits: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text: a bit is 1 if it is set in over half the shingles' hashes."""
    text, starts, ends, words = _words(data, limits)
    n = np.diff(words)
    counts = np.where(n > 0, np.maximum(1, n - size + 1), 0)
    of = np.repeat(np.arange(len(n)), counts)
    first = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + words[:-1][of]
    until = np.minimum(first + size, words[1:][of]) - 1
    ones = np.zeros((len(n), BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(of), HASHED):
        part = of[k : k + HASHED]
        spans = zip(starts[first[k : k + HASHED]].tolist(), ends[until[k : k + HASHED]].tolist(), strict=True)
        hashes = np.fromiter((digest(text[a:b], SEED) for a, b in spans), ">u8", len(part))
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        ones[part[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int32)
    packed = np.packbits(2 * ones > counts[:, None], axis=1)
    return packed.reshape(-1).view(">u8").astype(np.uint64)


def _describe(size: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text", PIECE_BYTES):
            found = fingerprints(*utf8(piece["text"]), size)
            yield pa.record_batch({"doc_id": piece["doc_id"], "id": pa.array(found.view(np.int64))})

    return describe


def _bits(low: Column, width: int, wild: Column) -> Column:
    """The bits of `id` from `low`, `width` of them, with the one at `wild` set."""
    one, shift = F.lit(1).cast("bigint"), lambda f, a, b: F.call_function(f, a, b.cast("int"))
    part = shift("shiftrightunsigned", F.col("id"), low).bitwiseAND(F.lit((1 << width) - 1))
    return part.bitwiseOR(shift("shiftleft", one, wild))


def _variants(members: DataFrame, width: int) -> DataFrame:
    """A row (id, key, free) for each segment and each bit in it that is left out.

    `members` holds id, key and free, the first of `width` bits that the key does not fix yet. The
    key is a hash: what clashes is compared in vain, but nothing is lost.
    """
    half = width // SEGMENTS
    low = F.col("free") + F.col("segment") * half
    other = F.col("free") + (1 - F.col("segment")) * half
    rows = members.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))))
    rows = rows.withColumn("wild", F.explode(F.sequence(F.lit(0), F.lit(half - 1))))
    key = F.xxhash64("key", low, "wild", _bits(low, half, F.col("wild")))
    return rows.select("id", key.alias("key"), other.alias("free"))


def _linked(distance: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in in_groups(batches, ["key"]):
            ids = np.unique(group["id"].to_numpy())
            if len(ids) < 2:
                continue
            values, a, b = ids.view(np.uint64), [], []
            # Members not yet reached; a member that is linked to several needs one link to each.
            roots = np.arange(len(ids))
            for k in range(1, len(ids)):
                near = np.bitwise_count(values[:k] ^ values[k]) <= distance
                for root in np.unique(roots[:k][near]).tolist():
                    a.append(ids[k])
                    b.append(ids[root])
                    roots[: k + 1][roots[: k + 1] == root] = k
                # The newest member stands for all that it is linked to.
            if a:
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return linked


def links(prints: DataFrame, distance: int = DISTANCE, most: int = GROUP) -> DataFrame:
    """Links (a, b) that connect all of `prints` (id, distinct) that differ in `distance` bits at most.

    Two fingerprints within two bits have a half that differs in one bit at most, so with that bit
    left out the halves are equal: both are in that variant's group. Groups over `most` are parted
    the same way by the bits that their variant does not fix, until none is.
    """
    if distance > 2 * SEGMENTS - 1:
        raise ValueError("no segment is sure to differ in one bit at most")
    members = prints.select("id", F.lit(0).cast("bigint").alias("key"), F.lit(0).alias("free"))
    width, found = BITS, None
    while True:
        keyed = _variants(members, width)
        counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        counts = stored(counts, "counts")
        # Counts grow with the fingerprints: no broadcast, and Spark can split a key with many rows.
        joined = keyed.join(counts.hint("merge"), "key")
        width //= SEGMENTS
        last = width <= 8
        small = joined if last else joined.filter(F.col("n") <= most)
        compared = (
            small.select("key", "id")
            .repartition(partitions(prints), "key")
            .sortWithinPartitions("key")
            .mapInArrow(_linked(distance), "a bigint, b bigint")
        )
        compared = stored(compared.distinct(), "links")
        found = compared if found is None else found.union(compared)
        if last or counts.filter(F.col("n") > most).isEmpty():
            return found.distinct()
        members = stored(
            joined.filter(F.col("n") > most).select("id", "key", "free").distinct(), "members"
        )


def simhash_groups(
    docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE, most: int = GROUP
) -> DataFrame:
    """Components of documents whose fingerprints differ in at most `distance` bits.

    `docs` has doc_id (long) and text; other columns are ignored. Returns, per input row, doc_id,
    fingerprint (16 hex digits) and component_id (the smallest doc_id reachable, itself included).

    Words are runs of anything but space and tab to carriage return, A-Z lower-cased; shingles of
    `size` words count as often as they occur, and a text with fewer words is one shingle. A text
    that is null or has no words has the fingerprint zero, which is linked like any other. Rows
    that share a doc_id are documents of their own. A null doc_id is never the smallest:
    component_id is null only where no other is reachable. An empty table gives an empty result.

    Rows with one fingerprint are one node, however many there are. Links are looked for as `links`
    says. Nothing is capped. Runs jobs while it is called.
    """
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    described = stored(texts.mapInArrow(_describe(size), "doc_id bigint, id bigint"), "fingerprints")
    classes = stored(described.groupBy("id").agg(F.min("doc_id").alias("least")), "classes")
    rooted = classes.join(components(links(classes, distance, most)), "id", "left")
    rooted = rooted.withColumn("root", F.coalesce("component", "id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    reached = rooted.select("id", "root").join(least, "root").select("id", "component_id")
    return described.join(stored(reached, "components"), "id").select(
        "doc_id",
        F.lower(F.lpad(F.hex("id"), 16, "0")).alias("fingerprint"),
        "component_id",
    )

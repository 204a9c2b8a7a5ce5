"""Passages that also occur earlier in the corpus, found with suffix arrays over shards."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seektrail.llm.common import in_groups, in_pieces, mix, packed, partitions, slices, unpack, utf8
from seektrail.llm.suffix_array import permuted_prefixes, suffix_array
from seektrail.plans.hot import stored

LENGTH = 100
# Length of the byte grams that decide which shard a passage goes to.
GRAM = 20
# Bytes of passages in a shard. Passages around one gram that hold more are dealt to several.
SHARD_BYTES = 2 << 20
# Bytes that a task looks at together; places within them take 24 bits.
_REACH = 2 << 20
_PLACE = np.uint64((1 << 24) - 1)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _rolling(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of the `size` bytes from every place on, built from runs of 1, 2, 4, ... bytes."""
    whole, width, covered = mix(_BYTES + np.uint64(seed))[data], 1, 0
    out = np.zeros(len(data), np.uint64)
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            out = out[: len(whole) - covered] * _TIMES[bit] + whole[covered:]
            covered += width
        if size >> (bit + 1):
            whole = whole[:-width] * _TIMES[16 + bit] + whole[width:]
            width *= 2
    return mix(out)


def _smallest(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of the `size` values from every place on."""
    width = 1
    while 2 * width <= size:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, limits: np.ndarray, length: int, gram: int, seed: int = 0):
    """Runs of windows of `length` bytes whose first smallest gram is the same one.

    Returns arrays: text, start in the text, number of windows, hash of the gram, hash of all
    bytes. Equal windows lie in runs with equal grams, at equal distance from the gram. `data` has
    at most 2^24 bytes, as places take 24 bits.
    """
    if len(data) > int(_PLACE) + 1:
        raise ValueError(f"{len(data)} bytes are more than places of 24 bits can tell apart")
    empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return empty
    grams = _rolling(data, gram, seed)
    keyed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    span = length - gram + 1
    chosen = (_smallest(keyed, span) & _PLACE).astype(np.int32)
    text = np.repeat(np.arange(len(limits) - 1, dtype=np.int32), np.diff(limits))[: len(chosen)]
    valid = np.arange(len(chosen)) + length <= limits[1:][text]
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (chosen[1:] != chosen[:-1])
    ends = valid.copy()
    ends[:-1] &= ~valid[1:] | begins[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    windows = last - first + 1
    size = windows + length - 1
    pieces = math.ceil((length + span - 1) / 64)
    width = min(64, length)
    block = _rolling(data, width)
    content = size.astype(np.uint64)
    for k in range(pieces):
        at = first + (size - width) * k // max(1, pieces - 1)
        content = mix(content + block[at] * _TIMES[k])
    return text[first].astype(np.int64), first - limits[:-1][text[first]], windows, grams[chosen[first]], content


def _split(length: int, gram: int):
    """Segments of whole texts. A text longer than the reach is taken in overlapping stretches."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text", _REACH // 2):
            data, limits = utf8(piece["text"])
            if len(data) <= _REACH:
                stretches = [(0, data, limits)]
            else:
                stretches = []
                for k, (a, b) in enumerate(zip(limits[:-1], limits[1:], strict=True)):
                    for s in range(a, max(b - length + 1, a + 1), _REACH):
                        e = min(b, s + _REACH + length - 1)
                        stretches.append((s - a, data[s:e], np.array([0, e - s]), k))
            for skipped, part, part_limits, *k in stretches:
                text, start, windows, grams, content = segments(part, part_limits, length, gram)
                rows = pa.array(text + k[0] if k else text)
                yield pa.record_batch(
                    {
                        "gram": pa.array(grams.view(np.int64)),
                        "content": pa.array(content.view(np.int64)),
                        "id": piece["id"].take(rows),
                        "v": piece["v"].take(rows),
                        "start": pa.array(start + skipped),
                        "windows": pa.array(windows.astype(np.int32)),
                    }
                )

    return split


_SEGMENT = "gram bigint, content bigint, id bigint, v bigint, start bigint, windows int"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for a shuffle."""
    for batch in slices(batches):
        sizes, values = packed(batch["text"])
        yield pa.record_batch({"id": batch["id"], "v": batch["v"], "size": sizes, "packed": values})


def _cut_out(length: int, gram: int, reach: int = _REACH):
    """Passages by their gram. Those of hot grams are cut anew, about `reach` bytes of them at a
    time; a passage has under 2 * `length` bytes and is never divided, so runs stay the same."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = batch.to_pylist()
            texts = [unpack(row["size"], row["packed"]) for row in rows]
            found = [(row, text, x) for row, text in zip(rows, texts, strict=True) for x in row["found"]]
            cut = [text[x["start"] : x["start"] + x["windows"] + length - 1] for _, text, x in found]
            hot = np.array([x["parts"] > 1 for *_, x in found], bool)
            grams = np.array([x["gram"] for *_, x in found], np.int64)
            starts = np.array([x["start"] for *_, x in found], np.int64)
            ids = np.array([row["id"] for row, *_ in found], np.int64)
            vs = np.array([row["v"] for row, *_ in found], np.int64)
            cold = np.flatnonzero(~hot)
            yield _passages(grams[cold], ids[cold], vs[cold], starts[cold], [cut[k] for k in cold], 1)
            some = np.flatnonzero(hot)
            ends = np.cumsum([len(cut[k]) for k in some], dtype=np.int64)
            for few in np.split(some, np.flatnonzero(np.diff(ends // reach)) + 1) if len(some) else ():
                limits = np.cumsum([0, *(len(cut[k]) for k in few)])
                data = np.frombuffer(b"".join(cut[k] for k in few), np.uint8)
                longer = (length + gram) // 2
                owner, at, windows, second, _ = segments(data, limits, length, longer, 3)
                own = few[owner]
                both = mix(grams[own].view(np.uint64) * _TIMES[5] + second).view(np.int64)
                runs = [cut[k][a : a + n + length - 1] for k, a, n in zip(own, at, windows, strict=True)]
                yield _passages(both, ids[own], vs[own], starts[own] + at, runs, 0)

    return cut_out


def _passages(grams, ids, vs, starts, passages: list[bytes], parts: int) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "gram": pa.array(grams),
            "parts": pa.array(np.full(len(passages), parts, np.int32)),
            "id": pa.array(ids),
            "v": pa.array(vs),
            "start": pa.array(starts),
            "bytes": pa.array(passages, pa.binary()),
        }
    )


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and place after the last of every run of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _repeats(length: int):
    """Of the segments of a shard: windows that occur earlier in it, and first windows of those
    segments whose other copies may be in another shard."""

    def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_groups(batches, ["shard"]):
            table = table.sort_by([("id", "ascending"), ("v", "ascending"), ("start", "ascending")])
            pieces = table["bytes"].to_pylist()
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            data = np.frombuffer(b"\0".join(pieces), np.uint8)
            begins = np.cumsum(sizes + 1) - sizes - 1
            piece = np.repeat(np.arange(len(pieces)), sizes + 1)[: len(data)]
            within = np.arange(len(data)) - begins[piece]
            valid = within + length <= sizes[piece]
            order = suffix_array(data)
            prefixes = permuted_prefixes(data, order)
            first = np.zeros(len(data), bool)
            whole = np.flatnonzero(valid[order])
            if len(whole):
                # Places that cross pieces may stand between equal windows, as texts may hold the
                # byte that parts pieces: common prefixes are taken over them.
                since = np.concatenate([[0], whole[:-1] + 1])
                shared = np.minimum.reduceat(prefixes[order[: whole[-1] + 1]], since)
                shared[0] = 0
                first[np.minimum.reduceat(order[whole], np.flatnonzero(shared < length))] = True
            a, b = _runs(valid & ~first)
            ids, vs, starts, parts = (table[c].to_numpy() for c in ("id", "v", "start", "parts"))
            nothing = pa.array(np.zeros(len(a), np.int64))
            yield pa.record_batch(
                {
                    "id": pa.array(ids[piece[a]]),
                    "v": pa.array(vs[piece[a]]),
                    "a": pa.array(starts[piece[a]] + within[a]),
                    "b": pa.array(starts[piece[a]] + within[a] + (b - a) + length - 1),
                    "w1": nothing,
                    "w2": nothing,
                    "open": pa.array(np.zeros(len(a), bool)),
                }
            )
            at = np.flatnonzero(valid & first & (parts[piece] > 1))
            if len(at):
                width = min(64, length)
                ends = at + length - width
                codes = []
                for seed in (1, 2):
                    block = _rolling(data, width, seed)
                    codes.append(mix(mix(block[at]) * _TIMES[seed] + block[ends]).view(np.int64))
                yield pa.record_batch(
                    {
                        "id": pa.array(ids[piece[at]]),
                        "v": pa.array(vs[piece[at]]),
                        "a": pa.array(starts[piece[at]] + within[at]),
                        "b": pa.array(starts[piece[at]] + within[at] + length),
                        "w1": pa.array(codes[0]),
                        "w2": pa.array(codes[1]),
                        "open": pa.array(np.ones(len(at), bool)),
                    }
                )

    return repeats


_REPEAT = "id bigint, v bigint, a bigint, b bigint, w1 bigint, w2 bigint, open boolean"


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """id, v and text, and whether any rows share an id or have none.

    v tells rows apart that share an id, and is 0 where none do."""
    docs = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    shared = docs.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 or id is null")
    if shared.isEmpty():
        return docs.withColumn("v", F.lit(0).cast("bigint")), False
    v = F.when(F.col("rows").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0))
    # Null ids come first in order, as the smallest number; they come out as null again.
    docs = docs.join(shared.filter("id is not null"), "id", "left")
    nulls = F.col("id").isNull()
    return docs.select(
        F.coalesce("id", F.lit(-(2**63))).alias("id"),
        "text",
        F.when(nulls, F.xxhash64("text")).otherwise(v).alias("v"),
    ), True


def repeated_passages(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    shard_bytes: int = SHARD_BYTES,
    reach: int = _REACH,
) -> DataFrame:
    """Per document with any: `found`, the stretches (a, b) of bytes that also occur earlier.

    See `remove_repeated`. Returns id, v (see `_keyed`) and the joined compressed text.
    """
    docs, ids_shared = _keyed(docs)
    tasks = partitions(docs)
    cut = docs.mapInArrow(_split(length, gram), _SEGMENT)
    often = cut.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # Stored, so that both sides of the join are shuffled for it and Spark can split a hot gram.
    often = stored(often.select("gram"), "often")
    common = stored(cut.join(often, "gram"), "segments")
    place = F.struct("id", "v", "start")
    firsts = stored(
        common.groupBy("gram", "content", "windows").agg(
            F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")
        ),
        "firsts",
    )
    later = (
        common.join(firsts.filter("rows > 1").drop("rows"), ["gram", "content", "windows"])
        .filter(place != F.col("first"))
        .select("id", "v", F.col("start").alias("a"), (F.col("start") + F.col("windows") + (length - 1)).alias("b"))
    )
    per_gram = (
        firsts.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("windows") + length).alias("bytes"))
        .filter("kinds > 1")
        .select("gram", F.ceil(F.col("bytes") / shard_bytes).cast("int").alias("parts"), "bytes")
    )
    total = per_gram.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    chosen = firsts.join(per_gram.drop("bytes"), "gram").select(
        "first.*",
        "gram",
        "windows",
        "parts",
    )
    lists = chosen.groupBy("id", "v").agg(
        F.collect_list(F.struct("gram", "start", "windows", "parts")).alias("found")
    )
    whole = docs.mapInArrow(_packed, "id bigint, v bigint, size bigint, packed binary")
    # Only rows that share an id can be equal; their passages are looked at once.
    once = whole.dropDuplicates(["id", "v"]) if ids_shared else whole
    passages = once.join(lists, ["id", "v"])
    cut = stored(
        passages.mapInArrow(
            _cut_out(length, gram, reach),
            "gram bigint, parts int, id bigint, v bigint, start bigint, bytes binary",
        ),
        "passages",
    )
    # What lies around a hot gram was dealt anew by a longer gram, most of which occur once then.
    hot = cut.filter("parts = 0").drop("parts")
    again = stored(
        hot.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("bytes")).alias("size"))
        .filter("rows > 1")
        .select("gram", F.ceil(F.col("size") / shard_bytes).cast("int").alias("parts")),
        "again",
    )
    part = F.pmod(F.xxhash64("bytes"), F.col("parts")).cast("int")
    ready = (
        cut.filter("parts = 1")
        .withColumn("part", F.lit(0))
        .unionByName(hot.join(again, "gram").withColumn("part", part))
    )
    shard = F.pmod(F.xxhash64("gram", "part"), F.lit(shards))
    repeats = stored(
        ready
        .withColumn("shard", shard)
        .repartition(max(tasks, min(shards, 20 * tasks)), "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_repeats(length), _REPEAT),
        "repeats",
    )
    # Windows of grams that were dealt to several shards: each shard names its first ones.
    rest = repeats.filter("open")
    known = (
        rest.groupBy("w1", "w2")
        .agg(F.min(F.struct("id", "v", "a")).alias("first"), F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1")
    )
    across = rest.join(known, ["w1", "w2"]).filter(F.struct("id", "v", "a") != F.col("first"))
    columns = ["id", "v", "a", "b"]
    spans = later.union(repeats.filter("not open").select(*columns)).union(across.select(*columns))
    found = spans.groupBy("id", "v").agg(F.collect_list(F.struct("a", "b")).alias("found"))
    return whole.join(found, ["id", "v"], "left")


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Stretches that overlap or touch, as one."""
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"]) for x in found or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))


def _whole_characters(text: bytes, span: tuple[int, int]) -> tuple[int, int]:
    """The span without characters that are only in part inside it."""
    a, b = span
    while a < b and text[a] & 0xC0 == 0x80:
        a += 1
    while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        rows = batch.to_pylist()
        texts = [unpack(r["size"], r["packed"]) for r in rows]
        spans = [merged(r["found"]) for r in rows]
        left = [_without(t, s) for t, s in zip(texts, spans, strict=True)]
        ids = [None if r["id"] == -(2**63) else r["id"] for r in rows]
        yield pa.record_batch(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_removed": pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                "n_spans": pa.array([len(s) for s in spans], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left]),
            }
        )


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        ids, vs, texts = [], [], []
        for r in batch.to_pylist():
            if r["found"]:
                text = unpack(r["size"], r["packed"])
                spans = [_whole_characters(text, s) for s in merged(r["found"])]
                ids.append(r["id"])
                vs.append(r["v"])
                texts.append(_without(text, spans).decode())
        yield pa.record_batch(
            {"id": pa.array(ids, pa.int64()), "v": pa.array(vs, pa.int64()), "clean": pa.array(texts, pa.string())}
        )


def suffix_dedup(docs: DataFrame, length: int = LENGTH, **limits: int) -> DataFrame:
    """Per document: bytes, bytes removed, runs removed, and the SHA-256 of what is left.

    `docs` has doc_id (long) and text (taken as UTF-8; null as empty); other columns are ignored.
    A byte is removed if it is inside a string of `length` bytes that also starts earlier: in a
    document with a smaller doc_id, or in the same one further left. Overlapping occurrences
    count, strings are judged on the input, and none crosses a document. The first occurrence
    stays. Texts shorter than `length` lose nothing. Rows that share a doc_id are ordered by a
    hash of their text; equal rows are one document, with equal results. Null doc_ids come first.
    An empty table gives an empty result.

    Every window of `length` bytes belongs to its smallest gram; grams that occur once hold no
    repeat. Windows around the same gram meet in one shard. Where they hold more than `shard_bytes`,
    they are told apart by a second, longer gram, which more often reaches into what differs; if
    that is not enough they are dealt to several shards whose first windows are merged. In a shard, a suffix array and its permuted common prefixes
    tell equal ones. Segments with equal bytes are counted as one before. Runs jobs while called.
    """
    columns = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return repeated_passages(docs, length, **limits).mapInArrow(_digest, columns)


def remove_repeated(docs: DataFrame, length: int = LENGTH, **limits: int) -> DataFrame:
    """`docs`, all columns and rows, with repeated passages (see `suffix_dedup`) cut from text.

    Characters that are only partly inside a removed run stay, so text remains valid. If
    the table has an n_chars column, it is brought up to date.
    """
    names = docs.columns
    clean = repeated_passages(docs, length, **limits).filter("found is not null").mapInArrow(
        _cleaned, "id bigint, v bigint, clean string"
    ).dropDuplicates(["id", "v"])
    one = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 or doc_id is null")
    v = F.lit(0).cast("bigint")
    if not one.isEmpty():
        own = F.col("doc_id").isNull() | F.col("__rows").isNotNull()
        docs = docs.join(one.select("doc_id", F.col("rows").alias("__rows")), "doc_id", "left")
        v = F.when(own, F.xxhash64("text")).otherwise(F.lit(0))
    joined = docs.withColumn("__id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("__v", v)
    clean = clean.withColumnsRenamed({"id": "__id", "v": "__v", "clean": "__clean"})
    joined = joined.join(clean, ["__id", "__v"], "left")
    joined = joined.withColumn("text", F.coalesce("__clean", "text"))
    if "n_chars" in names:
        chars = F.when(F.col("__clean").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        joined = joined.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return joined.select(*names)

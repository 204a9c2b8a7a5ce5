"""Ranked lexical search of whole documents with an automaton of all query terms."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seektrail.llm.common import in_pieces, partitions, slices, utf8
from seektrail.plans.hot import stored

BEST = 50
# Bytes of terms that one automaton holds; more of them are searched in several passes.
AUTOMATON_BYTES = 8 << 20
# Scores (documents times items) that a task holds at once.
CELLS = 2_000_000

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# Bytes that part terms become a space, A-Z are lower-cased, all others stay.
_GUARDED = bytes(
    b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)
_INSIDE = np.frombuffer(_GUARDED, np.uint8) != 32


def terms(text: str | None) -> list[str]:
    """All terms of a text in order, A-Z lower-cased."""
    return _TERM.findall((text or "").encode().lower().decode())


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [sorted(set(terms(x))) for x in batch["text"].to_pylist()]
        yield pa.record_batch(
            {"item_id": batch["item_id"], "terms": pa.array(found, pa.list_(pa.string()))}
        )


def _dealt(items: DataFrame, most: int) -> tuple[DataFrame, list[int]]:
    """Items with their distinct terms and a block; the blocks' terms hold `most` bytes at most.

    Items are dealt to twice as many blocks until none is larger, or each item is alone.
    """
    held = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    split = held.mapInArrow(_item_terms, "item_id bigint, terms array<string>")
    split = split.groupBy("item_id").agg(
        F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")
    )
    split = stored(split.filter(F.size("terms") > 0), "items")
    volume = F.sum(F.aggregate("terms", F.lit(0), lambda n, t: n + F.octet_length(t)))
    rows, total = split.agg(F.count(F.lit(1)), volume).first()
    if not rows:
        return split, []
    count = -(-total // most)
    while True:
        dealt = split.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(count)))
        sizes = dealt.groupBy("block").agg(volume.alias("bytes"), F.count(F.lit(1)).alias("n"))
        sizes = stored(sizes, "blocks")
        if count > rows**2 or sizes.filter(f"bytes > {most} and n > 1").isEmpty():
            return dealt, [row["block"] for row in sizes.select("block").collect()]
        count *= 2


def _count(wanted: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for k, term in enumerate(wanted):
            # Guarded by spaces, a term only matches as a whole; neighbours share a space.
            automaton.add_word(f" {term} ", k)
        automaton.make_automaton()
        for piece in in_pieces(batches, "text"):
            data, limits = utf8(piece["text"])
            inside = _INSIDE[data]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            starts = limits[:-1][limits[:-1] < len(data)]
            first[starts] = inside[starts]
            before = np.concatenate([[0], np.cumsum(first)])
            n = before[limits[1:]] - before[limits[:-1]]
            raw, found = data.tobytes(), []
            some = np.flatnonzero(n)
            for a, b in zip(limits[some].tolist(), limits[some + 1].tolist(), strict=True):
                text = b" ".join((b"", raw[a:b].translate(_GUARDED), b"")).decode()
                found.append(Counter(map(itemgetter(1), automaton.iter(text))))
            yield pa.record_batch(
                {
                    "doc_id": piece["doc_id"].take(pa.array(some)),
                    "n": pa.array(n[some], pa.int64()),
                    "terms": pa.array([list(x.keys()) for x in found], pa.list_(pa.int32())),
                    "tfs": pa.array([list(x.values()) for x in found], pa.list_(pa.int64())),
                }
            )

    return count


def _frequencies(size: int):
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch["terms"].flatten().to_numpy(zero_copy_only=False), minlength=size)
        term = np.flatnonzero(df)
        yield pa.record_batch({"term": pa.array(term, pa.int64()), "df": pa.array(df[term])})

    return frequencies


def _top(found: list[np.ndarray], best: int) -> list[np.ndarray]:
    """The best rows of each item among (item, score, no doc_id, doc_id), equal scores by doc_id."""
    item, score, none, doc = found
    order = np.lexsort((doc, none, -score, item))
    item = item[order]
    first = np.flatnonzero(np.diff(item, prepend=-1))
    rank = np.arange(len(item)) - np.repeat(first, np.diff(first, append=len(item)))
    return [x[order[rank < best]] for x in found]


def _score(
    ids: list[int | None],
    items_of: list[list[int]],
    weights: dict[int, int],
    docs: int,
    total: int,
    best: int,
):
    """Scores of documents for every item; a task hands on the best documents of each item."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = [np.array(x) for x in items_of]
        weight = np.zeros(len(of), np.int64)
        weight[list(weights)] = list(weights.values())
        pool = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        for batch in slices(batches, max(1, CELLS // len(ids))):
            lengths = batch["terms"].value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), lengths)
            term = batch["terms"].flatten().to_numpy(zero_copy_only=False)
            tf = batch["tfs"].flatten().to_numpy(zero_copy_only=False)
            n = batch["n"].to_numpy()
            m = 100 - 50 + (50 * n * docs) // total
            part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
            scores = np.zeros((batch.num_rows, len(ids)), np.int64)
            order = np.argsort(term, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(term[order], prepend=-1)), len(order))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = order[a:b]
                # A document has a term once, so no cell is added to twice.
                scores[np.ix_(doc[rows], of[term[rows[0]]])] += part[rows, None]
            row, item = np.nonzero(scores > 0)
            none = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            doc_id = batch["doc_id"].fill_null(0).to_numpy()
            new = [item, scores[row, item], none[row], doc_id[row]]
            pool = _top([np.concatenate(x) for x in zip(pool, new, strict=True)], best)
        item, value, none, doc_id = pool
        yield pa.record_batch(
            {
                "item_id": pa.array([ids[k] for k in item.tolist()], pa.int64()),
                "doc_id": pa.array(doc_id, mask=none),
                "score": pa.array(value),
            }
        )

    return score


def search(docs: DataFrame, items: DataFrame, best: int = BEST, most: int = AUTOMATON_BYTES) -> DataFrame:
    """The `best` documents for each item by the scores of their common terms.

    `docs` has doc_id and text, `items` item_id and text; other columns are ignored. Terms are runs
    of letters and digits of ASCII and of all other characters, A-Z lower-cased. Returns item_id,
    rank (from 1), doc_id and score: per item the documents with a score above 0, highest first,
    equal ones by ascending doc_id (null last).

    A text that is null or has no term counts for nothing. Repeated documents rank one by one.
    Rows of one item_id (null included) are one item with the terms of all; an item without terms
    has no rows. Empty tables give no rows.

    An automaton of the items' terms goes to every task, which counts them in whole texts in one
    pass and keeps the counts of the documents with a term; where the terms hold over `most` bytes,
    there is a pass for each block of items. A task keeps the best documents of an item; they
    meet in two steps. Runs jobs while it is called.
    """
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    dealt, blocks = _dealt(items, most)
    none = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    if not blocks:
        return none
    found = None
    for block in blocks:
        rows = dealt.filter(F.col("block") == block).collect()
        wanted = sorted({t for row in rows for t in row["terms"]})
        place = {t: k for k, t in enumerate(wanted)}
        items_of: list[list[int]] = [[] for _ in wanted]
        for k, row in enumerate(rows):
            for t in row["terms"]:
                items_of[place[t]].append(k)
        counts = stored(
            texts.mapInArrow(
                _count(wanted), "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
            ),
            "term_counts",
        )
        with_terms, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not with_terms:
            return none
        df = counts.select("terms").mapInArrow(_frequencies(len(wanted)), "term bigint, df bigint")
        weights = {
            row["term"]: math.floor(1000 * math.log((2 * with_terms + 2) / (2 * row["df"] + 1)))
            for row in df.groupBy("term").agg(F.sum("df").alias("df")).collect()
        }
        ids = [row["item_id"] for row in rows]
        scored = counts.mapInArrow(
            _score(ids, items_of, weights, with_terms, total, best),
            "item_id bigint, doc_id bigint, score bigint",
        )
        found = scored if found is None else found.union(scored)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(partitions(docs)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", "salt"], ["item_id"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("salt", salt).withColumn("rank", rank).filter(F.col("rank") <= best)
    return found.select("item_id", "rank", "doc_id", "score")

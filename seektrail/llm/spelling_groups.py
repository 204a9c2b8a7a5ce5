"""Grouping the spelling variants of words by an index of variable-length grams."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seektrail.llm.common import mix, partitions, slices
from seektrail.plans.hot import stored

LEAST_LETTERS = 7
LEAST_COUNT = 2
# A word takes the form of a near word that is so many times as frequent.
TIMES = 10
# One in so many (document, run) pairs loses a letter.
LOST = 31
# Lengths of grams, the boundary marks included. A gram that holds over 1/COMMON of all grams of
# its length is too common and gets longer, so the dictionary of common grams of a length has
# fewer than COMMON entries.
SHORTEST, LONGEST = 2, 5
COMMON = 5_000
# Lists over 1/LARGE of all entries are told apart when the cheapest lists of a word are chosen.
LARGE = 50_000
# Lists hold grams up to this far from either end of a word, so a very long word is in few lists.
REACH = 30
# Words that a task counts before it hands them on.
HELD = 200_000

_START, _END = "\x02", "\x03"


def _occurrences(least: int):
    run = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in slices(batches):
            ids, texts = batch["id"].to_pylist(), batch["text"].to_pylist()
            for doc_id, text in zip(ids, texts, strict=True):
                if not text:
                    continue
                # Of bytes, only A-Z are lower-cased.
                lowered = text.encode().lower().decode()
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(m[0] for m in run.finditer(lowered)).items():
                    h = zlib.crc32(word.encode(), prefix)
                    if h % LOST == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] += n
            if len(counts) > HELD:
                yield _counted(counts, "word")
                counts.clear()
        yield _counted(counts, "word")

    return occurrences


def _counted(counts: Counter[str], name: str) -> pa.RecordBatch:
    n = pa.array(counts.values(), pa.int64())
    return pa.record_batch({name: pa.array(counts.keys(), pa.string()), "n": n})


def word_counts(docs: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """Words of at least `least` letters that occur at least `count` times, and n, how often.

    A task counts its own words first, so a frequent word is a few rows of the shuffle.
    """
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_occurrences(least), "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= count)


def _marked(word: str) -> str:
    return f"{_START}{word}{_END}"


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each gram occurs that may still get longer. Few, as it is short."""
    counts: Counter[str] = Counter()
    for batch in slices(batches, 4_096):
        for word in map(_marked, batch["word"].to_pylist()):
            for q in range(SHORTEST, LONGEST):
                counts.update([word[p : p + q] for p in range(len(word) - q + 1)])
        if len(counts) > HELD:
            yield _counted(counts, "gram")
            counts.clear()
    yield _counted(counts, "gram")


def common_grams(words: DataFrame, share: int = COMMON) -> set[str]:
    """The grams that are too common to be lists; fewer than `share` of each length."""
    counts = words.select("word").mapInArrow(_count_grams, "gram string, n bigint")
    counts = counts.groupBy("gram").agg(F.sum("n").alias("n")).withColumn("q", F.length("gram"))
    counts = stored(counts, "grams")
    limits = counts.groupBy("q").agg((F.sum("n") / share).alias("most"))
    return {row["gram"] for row in counts.join(limits, "q").filter("n > most").select("gram").collect()}


def decompose(word: str, common: set[str]) -> list[tuple[int, str]]:
    """(start, gram) for each place of the marked word from which a gram fits.

    The gram at a place is the shortest that is not common, or as long as grams get. It depends on
    its own letters only, so one changed letter affects just the grams that hold it.
    """
    word, out = _marked(word), []
    for p in range(len(word) - SHORTEST + 1):
        q = SHORTEST
        while q < LONGEST and p + q < len(word) and word[p : p + q] in common:
            q += 1
        out.append((p, word[p : p + q]))
    return out


def affected_bound(spans: list[tuple[int, int]]) -> int:
    """The most of the spans (first, last place of a gram) that one edit can affect."""
    return max(sum(a <= first <= b for a, b in spans) for first, _ in spans)


def _key(gram: str, right: int, at: int, length: int) -> int:
    """A list's number; lists that share one are only longer, as pairs are verified."""
    return zlib.crc32(gram.encode()) << 32 | right << 31 | at << 24 | min(length, (1 << 24) - 1)


def _lists(word: str, common: set[str]) -> list[tuple[int, int, int, int]]:
    """(first place, last place, side, key without length) of each list that holds the word.

    A gram left of an edit stays where it is from the start (side 0), one right of it from the
    end (side 1).
    """
    n, out = len(word), []
    for p, gram in decompose(word, common):
        last = p + len(gram) - 1
        if p < REACH:
            out.append((p, last, 0, _key(gram, 0, p, 0)))
        if n + 1 - last < REACH:
            out.append((p, last, 1, _key(gram, 1, n + 1 - last, 0)))
    return out


def _mixed(keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Keys of lists that hold words of one length only."""
    return mix(keys.astype(np.uint64) ^ mix(lengths.astype(np.uint64))).view(np.int64)


def _index(common: set[str]):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_024):
            words = batch["word"].to_pylist()
            lists = [_lists(w, common) for w in words]
            of = np.repeat(np.arange(len(words)), [len(x) for x in lists])
            keys = np.fromiter((x[3] for y in lists for x in y), np.uint64, len(of))
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            rows = batch.take(pa.array(of))
            yield pa.record_batch(
                {"key": pa.array(_mixed(keys, lengths[of])), "near": rows["word"]}
                | {"near_n": rows["n"], "near_letters": rows["letters"]}
            )

    return index


def choose(lists: list[tuple[int, int, int, int]], costs: list[int]) -> list[int]:
    """The keys of the cheapest of a word's lists among which every near word must be found once.

    Two grams are taken, one left of the other, so that no edit affects both: the bound of affected
    grams is one, and a near word is in the left one's list from the start or in the right one's
    from the end.
    """
    lefts = sorted((b, cost, a, key) for (a, b, side, key), cost in zip(lists, costs) if side == 0)
    rights = sorted((a, cost, b, key) for (a, b, side, key), cost in zip(lists, costs) if side == 1)
    best = left = None
    at = 0
    for a, cost, b, key in rights:
        while at < len(lefts) and lefts[at][0] < a:
            if left is None or lefts[at][1] < left[1]:
                left = lefts[at]
            at += 1
        if left is not None and (best is None or left[1] + cost < best[0]):
            best = (left[1] + cost, left, (a, b, key))
    if best is None or affected_bound([(best[1][2], best[1][0]), best[2][:2]]) > 1:
        raise ValueError("no two grams of a word lie apart")
    return [best[1][3], best[2][2]]


def _probe(common: set[str], sizes: dict[int, int]):
    """Three rows, for the lengths of near words, for each chosen list. `sizes` has the large ones."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array(sorted(sizes) or [0], np.int64)
        size = np.array([sizes.get(k, 1) for k in known.tolist()], np.int64)
        for batch in slices(batches, 1_024):
            words = batch["word"].to_pylist()
            lists = [_lists(w, common) for w in words]
            limits = np.cumsum([0, *map(len, lists)])
            n = np.fromiter(map(len, words), np.int64, len(words))
            keys = np.fromiter((x[3] for y in lists for x in y), np.uint64, limits[-1])
            costs = np.zeros(len(keys), np.int64)
            for d in (-1, 0, 1):
                key = _mixed(keys, np.repeat(n, np.diff(limits)) + d)
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                costs += np.where(known[at] == key, size[at], 1)
            costs = costs.tolist()
            chosen = [choose(x, costs[a:b]) for x, a, b in zip(lists, limits[:-1], limits[1:], strict=True)]
            keys = np.array(chosen, np.uint64)
            mixed = [_mixed(keys[:, k], n + d) for k in range(keys.shape[1]) for d in (-1, 0, 1)]
            rows = batch.take(pa.array(np.tile(np.arange(len(words)), len(mixed))))
            yield pa.record_batch(
                {"key": pa.array(np.concatenate(mixed)), "word": rows["word"]}
                | {"letters": rows["letters"]}
            )

    return probe


def near_words(words: DataFrame, common_share: int = COMMON, large: int = LARGE) -> DataFrame:
    """(word, near, near_n) for every ordered pair of words that one edit of a letter parts.

    `words` holds word (unique, at least seven letters, stored) and n.
    """
    common = common_grams(words, common_share)
    # One edit changes the parity of two letters at most: a check that needs no words compared.
    letters = F.aggregate(
        F.split("word", ""),
        F.lit(0).cast("bigint"),
        lambda bits, c: F.when(c == "", bits).otherwise(
            bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(c) % 64))
        ),
    )
    words = stored(words.withColumn("letters", letters).repartition(partitions(words), "word"), "words")
    index = words.mapInArrow(_index(common), "key bigint, near string, near_n bigint, near_letters bigint")
    lists = stored(index.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "lists")
    most = lists.agg(F.sum("size") / large).first()[0] or 0
    sizes = {row["key"]: row["size"] for row in lists.filter(F.col("size") > most).collect()}
    probes = words.mapInArrow(_probe(common, sizes), "key bigint, word string, letters bigint")
    alike = F.bit_count(F.col("letters").bitwiseXOR(F.col("near_letters"))) <= 2
    return (
        # The lists are far larger than the words that they are made from, so none is broadcast.
        probes.join(index.hint("merge"), "key")
        .filter(alike & (F.levenshtein("word", "near", 1) == 1))
        .select("word", "near", "near_n")
        .dropDuplicates(["word", "near"])
    )


def _roots(forms: DataFrame) -> DataFrame:
    """The last form of each word that has one. Forms are ever more frequent, so chains are short.

    Pointers double in each round, and a round is written before the next one starts.
    """
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = roots.join(ahead, "root", "left")
        if moved.filter("further is not null").isEmpty():
            return roots
        roots = stored(moved.select("word", F.coalesce("further", "root").alias("root")), "roots")


def spelling_groups(
    docs: DataFrame, least: int = LEAST_LETTERS, times: int = TIMES, common_share: int = COMMON
) -> DataFrame:
    """Words of the documents with the more frequent word that each is a spelling variant of.

    `docs` has doc_id and text; other columns are ignored. Words are runs of A-Z, a-z and U+00C0 to
    U+00FF, of which A-Z are lower-cased. Where 31 divides the CRC-32 of `<doc_id>:<run>`, the run
    loses a letter. Words of at least `least` letters that occur twice or more are kept. Returns

    * word, n: a word and its number of occurrences;
    * n_near: the words that differ by exactly one inserted, deleted or replaced letter;
    * form, form_n: the most frequent of those (ties: first in code-point order) and its n, if
      that is at least `times` the word's, else null;
    * root: the last of the forms of forms, the word itself if it has none.

    A null text has no words, nor has an empty one or one without letters. A null doc_id counts as
    an empty one in the CRC-32. Repeated rows count as often as they occur. An empty table gives an
    empty result. A very long run of letters is a word like any other.

    Words are decomposed into grams of two to five letters (boundaries included), longer where the
    shorter ones are common. Of each word, the cheapest two lists are read among which one edit
    cannot affect both grams; what they hold is checked by edit distance. Nothing is capped.
    Runs jobs while it is called.
    """
    if least < 2 * LONGEST - 3:
        raise ValueError("shorter words have no two grams that lie apart")
    words = stored(word_counts(docs, least), "counts")
    near = near_words(words, common_share)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    summed = stored(near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "near")
    told = words.join(summed, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.col("best.form").alias("form"),
        (-F.col("best.less")).alias("form_n"),
    )
    fits = F.col("form_n") >= times * F.col("n")
    told = stored(
        told.withColumns({c: F.when(fits, F.col(c)) for c in ("form", "form_n")}), "forms"
    )
    roots = _roots(told.filter("form is not null"))
    return told.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )

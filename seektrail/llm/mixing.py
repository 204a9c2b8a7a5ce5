"""Mixing sources to target weights by apportioning equal blocks of words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seektrail.llm.common import WORD, null_safe_join
from seektrail.plans.hot import stored

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 32
SHARD_WORDS = 1_000_000
SEED = 11
# Halvings of the interval that holds the divisor; more than a double can tell apart.
_HALVINGS = 64


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, a hash of the text, and size (words of the whole text; 0 for null)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    source, code = F.col("source").cast("string"), F.xxhash64("text")
    return docs.select("doc_id", source.alias("source"), code.alias("code"), size.alias("size"))


def targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """Add weight and target to a table (source, source_size).

    Sources in code point order, null last, weigh `weights`, repeating, and share `share` times
    all words. A target stops at `most` times its source's size; the excess is shared again
    by weight until none is above. Sources that stop are those with the lowest size per weight, so
    one pass in that order finds them all: the first that need not stop,
    which gives the highest level, ends it.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(ordered) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1))
    table = sources.withColumn("weight", weight).withColumn("limit", most * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    table = table.withColumn("level", left / F.sum("weight").over(onwards))
    ends = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    table = table.withColumn("level", F.max(ends).over(every))
    target = F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("limit")), F.col("limit"))
    return table.select("source", "source_size", "weight", target.alias("target"))


def _rounded(votes: Column, divisor: Column, most: Column) -> Column:
    return F.floor(F.least(votes / divisor + 0.5, most.cast("double")))


def _divisor(classes: Column, seats: Column) -> Column:
    """A divisor by which rounding the votes, up to the most, gives too few seats or just enough."""

    def given(d: Column) -> Column:
        return F.aggregate(
            classes, F.lit(0.0), lambda a, c: a + c["cells"] * _rounded(c["votes"], d, c["most"])
        )

    highest = F.aggregate(classes, F.lit(0.0), lambda a, c: F.greatest(a, c["votes"]))
    start = F.struct(F.lit(0.0).alias("low"), (2 * highest + 1).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = (state["low"] + state["high"]) / 2
        over = given(middle) > seats
        return F.struct(
            F.when(over, middle).otherwise(state["low"]).alias("low"),
            F.when(over, state["high"]).otherwise(middle).alias("high"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(_HALVINGS)), start, halve)["high"]


def sainte_lague(cells: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add `seats` to cells (votes, seats_in_all, most) by highest quotients votes / (2k + 1).

    Within a group of cells all `seats_in_all` (equal in each of its rows) are given out, none
    of them to a cell that has its `most`. Equal quotients are served in the given order. A divisor that
    leaves at most the tied seats is found by halving; those go by the next quotient.

    Cells with equal votes and most are a class, counted before anything is shuffled, and the divisor
    is found once per group from its classes: votes that are multiples of whole blocks have as many
    classes as numbers of blocks differ, however many cells there are. Cells are
    ordered only among those with equal next quotients.
    """
    group = list(group)
    classes = cells.groupBy(*group, "votes", "most").agg(
        F.count(F.lit(1)).alias("cells"), F.max("seats_in_all").alias("in_all")
    )
    each = F.collect_list(F.struct("votes", "most", "cells"))
    groups = classes.groupBy(*group).agg(each.alias("classes"), F.max("in_all").alias("in_all"))
    groups = groups.withColumn("divisor", _divisor(F.col("classes"), F.col("in_all")))
    classes = groups.select(*group, "in_all", "divisor", F.inline("classes"))
    base = _rounded(F.col("votes"), F.col("divisor"), F.col("most"))
    classes = classes.withColumn("seats", F.coalesce(base, F.lit(0)).cast("bigint"))
    room = F.when(F.col("seats") < F.col("most"), F.col("votes") / (2 * F.col("seats") + 1))
    missing = F.col("in_all") - F.sum(F.col("cells") * F.col("seats")).over(Window.partitionBy(*group))
    classes = classes.withColumn("room", room).withColumn("missing", missing)
    # The cells that come before those with this next quotient; equal quotients are peers.
    upto = F.sum("cells").over(Window.partitionBy(*group).orderBy(F.desc_nulls_last("room")))
    before = upto - F.sum("cells").over(Window.partitionBy(*group, "room"))
    classes = classes.withColumn("missing", F.col("missing") - before)
    keys = [*group, "votes", "most"]
    cells = null_safe_join(cells, classes.select(*keys, "seats", "room", "missing"), keys, "inner")
    place = F.row_number().over(Window.partitionBy(*group, "room").orderBy(*order))
    extra = (place <= F.col("missing")) & F.col("room").isNotNull()
    return cells.withColumn("seats", F.col("seats") + extra.cast("bigint")).drop("room", "missing")


def _placed(
    sized: DataFrame,
    weights: Sequence[float],
    share: float,
    most: int,
    block_words: int,
    shard_words: int,
    seed: int,
) -> DataFrame:
    """The rows of `sizes` with target, whole `copies`, and up to two ranges of words (a, b)."""
    sources = targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most
    )
    sources = stored(
        sources.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))),
        "sources",
    )
    dice = F.xxhash64(F.lit(seed), "doc_id")
    dealt = null_safe_join(sized, sources, ["source"], "inner")
    dealt = dealt.withColumn("dice", dice).withColumn("shard", F.pmod("dice", F.col("shards")))
    # Shards: length of the line, its number of blocks, and what the source's target asks of it.
    lines = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("line"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
    )
    blocks = F.when(F.col("line") > 0, F.greatest(F.round(F.col("line") / block_words), F.lit(1))).otherwise(0)
    lines = lines.withColumn("blocks", blocks.cast("bigint")).withColumn("most", most * F.col("blocks"))
    lines = stored(lines, "lines")
    asked = F.col("target") / F.greatest("source_size", F.lit(1))  # times over
    totals = lines.groupBy("source").agg(
        F.sum("most").alias("most"), (F.max(asked) * F.sum("blocks")).alias("votes")
    )
    in_all = F.round(F.sum("votes").over(Window.partitionBy()))
    quotas = sainte_lague(
        totals.withColumn("seats_in_all", in_all), [], [F.col("source").asc_nulls_last()]
    ).select("source", F.col("seats").alias("seats_in_all"))
    lines = null_safe_join(lines, quotas, ["source"], "inner")
    lines = lines.withColumn("votes", asked * F.col("blocks"))
    lines = sainte_lague(lines, ["source"], [F.col("shard")])
    from_block = F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), F.greatest("blocks", F.lit(1)))
    lines = lines.select("source", "shard", "line", "blocks", "seats", from_block.alias("from_block"))
    lines = stored(lines, "quotas")
    along = Window.partitionBy("source", "shard").orderBy("dice", "doc_id", "size")
    start = F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = null_safe_join(dealt.withColumn("start", start), lines, ["source", "shard"], "inner")
    count = F.greatest("blocks", F.lit(1))
    rest = F.col("seats") % count

    def at(block: Column) -> Column:  # where a block begins on the line
        return F.floor(block * F.col("line") / count)

    def part(a: Column, b: Column) -> Column:  # which words of a document lie between
        low = F.least(F.greatest(a - F.col("start"), F.lit(0)), F.col("size"))
        high = F.least(F.greatest(b - F.col("start"), F.lit(0)), F.col("size"))
        return F.struct(low.cast("bigint").alias("a"), F.greatest(low, high).cast("bigint").alias("b"))

    stop = F.col("from_block") + rest
    parts = F.array(
        part(at(F.col("from_block")), at(F.least(stop, count))),
        part(F.lit(0), at(F.greatest(stop - count, F.lit(0)))),
    )
    copies = F.floor(F.col("seats") / count).cast("int")
    return placed.select(*sized.columns, "source_size", "target", copies.alias("copies"), parts.alias("parts"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """Per document: source, size, source_size, target of its source, and words `taken`.

    `docs` has doc_id, text and source; other columns are ignored. A null text has no words; a null
    source is a source, the last one. An empty table gives an empty result.

    A source is dealt to shards of about `shard_words` by a seeded hash, so a large one is many
    shards; a shard's documents, in seeded order, are one line of words, cut into blocks of
    about `block_words` (equal to within one word). Sainte-Laguë gives the blocks of the whole
    mix to the sources by their targets, then each source's quota to its shards. A shard
    takes its whole line as often as its quota allows, and the blocks that remain from a seeded
    block on, around the line's end. So no document is taken more than `most` times, each source's
    words are its target but for half a block per shard, and reruns agree. Rows that share a
    doc_id count one by one; equal rows may take different parts. Runs jobs while called. Only
    built-in functions are used.
    """
    placed = _placed(
        stored(sizes(docs), "sizes"), weights, share, most, block_words, shard_words, seed
    )
    partly = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["b"] - p["a"])
    taken = F.col("copies") * F.col("size") + partly
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def take(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: the columns of `docs`, a row for every time that a document is taken.

    See `mix_sources`. A document that is taken in part has a row with just those words, and the
    white space before each; n_chars, if there is such a column, is brought up to date. Documents
    without words are in no block and are left out. Rows that repeat doc_id, source and text
    are one document.
    """
    names, keys = docs.columns, ["doc_id", "source", "code"]
    sized = stored(sizes(docs), "sizes")
    docs = docs.withColumns({"__code": F.xxhash64("text"), "__source": F.col("source").cast("string")})
    if not sized.groupBy(*keys).count().filter("count > 1").isEmpty():
        docs = docs.dropDuplicates(["doc_id", "__source", "__code"])
        sized = sized.dropDuplicates(keys)
    placed = _placed(sized, weights, share, most, block_words, shard_words, seed)
    whole = F.struct(F.lit(0).cast("bigint").alias("a"), F.col("size").alias("b"))
    taken = F.concat(
        F.array_repeat(whole, F.col("copies")), F.filter("parts", lambda p: p["a"] < p["b"])
    )
    placed = placed.filter("size > 0").select(
        F.col("doc_id").alias("__id"),
        F.col("source").alias("__from"),
        F.col("code").alias("__hash"),
        F.col("size").alias("__size"),
        taken.alias("__taken"),
    )
    same = (
        F.col("doc_id").eqNullSafe(F.col("__id"))
        & F.col("__source").eqNullSafe(F.col("__from"))
        & (F.col("__code") == F.col("__hash"))
    )
    rows = docs.join(placed, same).withColumn("__part", F.explode("__taken"))
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"))
    length = (F.col("__part.b") - F.col("__part.a")).cast("int")
    cut = F.array_join(F.slice(words, F.col("__part.a").cast("int") + 1, length), "")
    partly = F.col("__part.b") - F.col("__part.a") < F.col("__size")
    rows = rows.withColumn("text", F.when(partly, cut).otherwise(F.col("text")))
    if "n_chars" in names:
        chars = F.when(partly, F.length("text")).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType))
    return rows.select(*names)

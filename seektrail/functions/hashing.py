"""Hashes that do not depend on partitioning, engine or run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stands for null in hashed text, so that a null moved to another column changes the hash.
NULL_MARK = "\\N"
SEPARATOR = "\x1f"
# Types whose text holds neither backslashes nor separators.
PLAIN_TYPES = {
    "tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp",
    "timestamp_ntz",
}
# Keys are told apart by the first 60 bits of their md5.
KEY_SPACE = 2**60


def _hex_word(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 8), 16, 10)


def key_hash(column: str | Column) -> Column:
    """A number in [0, KEY_SPACE) that is the same for equal keys of one type in any table."""
    column = F.col(column) if isinstance(column, str) else column
    return F.conv(F.substring(F.md5(column.cast("string")), 1, 15), 16, 10).cast("bigint")


def fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (rows, hash_1, hash_2): equal for equal multisets of rows in any order.

    Each row's md5 gives two 32-bit words, summed over all rows. Columns of other types than
    text, number, date and the like are hashed as Spark prints them.
    """
    kinds = dict(df.dtypes)
    text = [F.coalesce(as_text(c, kinds[c]), F.lit(NULL_MARK)) for c in columns or df.columns]
    digest = F.md5(F.concat_ws(SEPARATOR, *text))
    words = df.select(
        _hex_word(digest, 1).cast("bigint").alias("word_1"),
        _hex_word(digest, 9).cast("bigint").alias("word_2"),
    )
    return words.agg(
        F.count(F.lit(1)).alias("rows"),
        _wide_sum("word_1").alias("hash_1"),
        _wide_sum("word_2").alias("hash_2"),
    )


def as_text(column: str, kind: str) -> Column:
    """Text in which neither the null mark nor the separator can occur."""
    if kind.startswith("map"):  # equal maps may list their entries in another order
        text = F.array_sort(F.map_entries(column)).cast("string")
    else:
        text = F.col(column).cast("string")
    if kind in PLAIN_TYPES or kind.startswith("decimal"):
        return text
    backslash = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(backslash, F.lit(SEPARATOR), F.lit("\\S"))


def _wide_sum(word: str) -> Column:
    """Sum of 32-bit words as text.

    The halves of the words are summed apart: those sums fit a bigint for over 10^14 rows, and
    adding up bigints is much faster than adding up wide decimals.
    """
    high, low = F.shiftright(word, 16), F.col(word).bitwiseAND(F.lit(0xFFFF))
    sums = [F.coalesce(F.sum(half), F.lit(0)).cast("decimal(20,0)") for half in (high, low)]
    return (sums[0] * F.lit(0x10000).cast("decimal(6,0)") + sums[1]).cast("string")

"""Replacing identifiers by pseudonyms, and finding or masking personal data in text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



class Pattern(NamedTuple):
    """A regular expression, and a text that every match contains, if there is one.

    Texts without it are not searched.
    """

    contains: str | None
    regex: str


# What counts as personal data in text. Nothing limits the length of an address; the
# look-behind and the possessive marks keep matching linear on long runs of letters.
PATTERNS = {
    "email": Pattern(
        "@",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*[A-Za-z0-9]",
    ),
    "ip": Pattern(None, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"),
    "phone": Pattern(None, r"[0-9]{3}-[0-9]{3,4}-[0-9]{4}"),
}


def pseudonym(column: str, salt: str) -> Column:
    """Salted SHA-256 of an identifier; null stays null.

    The salt is part of the query plan: on a shared cluster, redact it from the event log
    (`spark.sql.redaction.string.regex`).
    """
    return F.sha2(F.concat(F.lit(salt), F.lit(":"), F.col(column).cast("string")), 256)


def pseudonymize(
    tables: Mapping[str, DataFrame], key_cols: Mapping[str, Sequence[str]], salt: str
) -> dict[str, DataFrame]:
    """All tables, the named key columns replaced by pseudonyms.

    Equal identifiers get equal pseudonyms in every table, so the tables still join.
    """
    if not salt:
        raise ValueError("an unsalted hash of an identifier can be reversed by trying them all")
    if unknown := set(key_cols) - set(tables):
        raise ValueError(f"no such tables: {sorted(unknown)}")
    return {
        name: df.withColumns({c: pseudonym(c, salt) for c in key_cols.get(name, ())})
        for name, df in tables.items()
    }


def _searched(text: Column, pattern: Pattern) -> Column:
    return text.isNotNull() if pattern.contains is None else F.contains(text, F.lit(pattern.contains))


def pii_scan(
    df: DataFrame, text_col: str, patterns: Mapping[str, Pattern] = PATTERNS
) -> DataFrame:
    """Rows with hits, and hits, per pattern over the whole texts, all in one pass."""
    text = F.col(text_col)
    counts = df.select(
        *[
            F.when(_searched(text, p), F.regexp_count(text, F.lit(p.regex)))
            .otherwise(0)
            .alias(f"hits_{i}")
            for i, p in enumerate(patterns.values())
        ]
    )
    results = [
        F.struct(
            F.lit(name).alias("pattern"),
            F.count_if(F.col(f"hits_{i}") > 0).alias("rows"),
            F.coalesce(F.sum(f"hits_{i}"), F.lit(0)).alias("hits"),
        )
        for i, name in enumerate(patterns)
    ]
    return counts.agg(F.array(*results).alias("results")).select(F.inline("results"))


def pii_mask(
    df: DataFrame, text_col: str, patterns: Mapping[str, Pattern] = PATTERNS
) -> DataFrame:
    """The table with every hit in the text replaced by its pattern's name in brackets."""
    text = F.col(text_col)
    for name, pattern in patterns.items():
        masked = F.regexp_replace(text, pattern.regex, f"[{name}]")
        df = df.withColumn(
            text_col, F.when(_searched(text, pattern), masked).otherwise(text)
        )
    return df


def pii_report(
    tables: Mapping[str, DataFrame], patterns: Mapping[str, Pattern] = PATTERNS
) -> DataFrame:
    """Rows (table, column, pattern, rows, hits) for every text column, one pass per table."""
    reports = []
    for name, df in tables.items():
        results = []
        for c in [c for c, kind in df.dtypes if kind == "string"]:
            for label, p in patterns.items():
                hits = F.when(_searched(F.col(c), p), F.regexp_count(c, F.lit(p.regex))).otherwise(0)
                results.append(
                    F.struct(
                        F.lit(name).alias("table"),
                        F.lit(c).alias("column"),
                        F.lit(label).alias("pattern"),
                        F.count_if(hits > 0).alias("rows"),
                        F.coalesce(F.sum(hits), F.lit(0)).alias("hits"),
                    )
                )
        if results:
            reports.append(df.agg(F.array(*results).alias("all")).select(F.inline("all")))
    if not reports:
        raise ValueError("no table has a text column")
    return reduce(DataFrame.unionByName, reports)

"""Allowing or blocking urls by rules and by a logistic regression on their characters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = 1 << 15
GRAMS = (3, 4, 5)
# A labelled table with more rows than this is refused: it is trained on the driver.
MOST_LABELLED = 20_000
# Scores of hosts and paths that a task remembers.
_REMEMBERED = 100_000

# Rules as (verdict, rule). Fixed values.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

# A small labelled table for training: (url, to be blocked). Fixed values.
LABELLED = (
    ("http://cheap-pills.example.org/en/1", True),
    ("https://www.cheap-pills-online.example.net/de/buy", True),
    ("http://pills-4u.example.org/shop", True),
    ("https://spam-farm.example.net/en/22.html", True),
    ("http://www.spam-links.example.org/a", True),
    ("https://link-farm.example.org/en/77", True),
    ("https://adult-x.example.org/en/5", True),
    ("http://m.adult-videos.example.net/fr/8", True),
    ("https://xxx-adult.example.net/de/90", True),
    ("http://free-bets.example.net/en/31", True),
    ("https://www.bets-casino.example.org/en/4", True),
    ("http://casino-free.example.org/es/61", True),
    ("https://ads-track.example.net/en/14", True),
    ("http://track-ads.example.org/click", True),
    ("https://m.ads-click.example.net/de/3", True),
    ("http://malware-kit.example.org/en/12", True),
    ("https://free-warez.example.net/download", True),
    ("http://fast-loans.example.org/en/9", True),
    ("https://ththly.example.org/en/825", False),
    ("http://www.therning.example.net/en/25.html", False),
    ("https://blog.tionter.example.org/de/685", False),
    ("http://ththand.example.net/en/676?page=2", False),
    ("https://m.therthe.example.org/fr/770#top", False),
    ("http://thertion.example.net/de/853/", False),
    ("https://www.ththes.example.org/en/960", False),
    ("http://blog.ingther.example.net/en/474", False),
    ("https://library.example.org/en/books/12", False),
    ("http://www.weather.example.net/de/today", False),
    ("https://blog.gardening.example.org/en/roses", False),
    ("http://history.example.net/en/rome", False),
    ("https://m.newsroom.example.org/en/2024/01", False),
    ("http://wiki.example.net/en/page", False),
    ("https://school.example.org/es/maths", False),
    ("http://www.thereth.example.org/es/369", False),
    ("https://ththion.example.net/de/671", False),
    ("http://museum.example.org/fr/art", False),
    ("https://national-table.example.org/en/3", False),
    ("http://double.example.org/de/44", False),
    ("https://www.notable.example.net/en/101", False),
    ("https://m.athens.example.net/de/59", False),
    ("http://theatre-rat.example.net/en/7.html", False),
    ("https://blog.nationth.example.net/en/18", False),
    ("http://ontion.example.org/en/240/", False),
    ("https://m.thenth.example.org/de/92", False),
    ("http://www.therould.example.net/en/537", False),
    ("https://ththough.example.net/de/300", False),
    ("http://blog.therst.example.org/en/88", False),
    ("https://m.reading-room.example.net/en/15", False),
    ("http://harbour.example.org/de/210?page=2", False),
    ("https://www.engine.example.net/en/640", False),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty for a null url or one without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(
        F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits (struct of rule and verdict), or null."""

    def fits(rule: str) -> Column:
        rule_host, slash, rest = rule.partition("/")
        return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)

    ordered = sorted(rules, key=lambda r: -len(r[1]))
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")
    found = [F.when(fits(r), F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"))) for v, r in ordered]
    return F.coalesce(*found, nothing)


def _features(kind: str, text: str) -> np.ndarray:
    """Places of the distinct hashed character n-grams of a host or path."""
    marked = f"^{text}$"
    grams = {marked[k : k + n] for n in GRAMS for k in range(len(marked) - n + 1)}
    places = {zlib.crc32(f"{kind}:{g}".encode()) % DIMENSIONS for g in grams}
    return np.fromiter(places, np.int64, len(places))


def _score(weights: np.ndarray, kind: str, text: str) -> float:
    places = _features(kind, text)
    return float(weights[places].sum() / np.sqrt(max(1, len(places))))


def train(labelled: DataFrame, most: int = MOST_LABELLED, rounds: int = 400) -> np.ndarray:
    """Weights of the hashed n-grams, then the bias, from a table (url, blocked).

    Full-batch gradient descent with a small ridge. Rows with nulls are left out; without both
    labels all weights are 0 and the bias says which label there is (0 if none). More than
    `most` rows raise ValueError: the table is meant to be small and comes to the driver.
    """
    host, path = host_and_path(F.col("url"))
    rows = (
        labelled.filter("url is not null and blocked is not null")
        .select(host.alias("host"), path.alias("path"), F.col("blocked").cast("int").alias("y"))
        .limit(most + 1)
        .collect()
    )
    if len(rows) > most:
        raise ValueError(f"the labelled table has more than {most} rows")
    weights = np.zeros(DIMENSIONS + 1)
    rows = sorted(rows)
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        weights[-1] = 0.0 if not len(y) else 10.0 * (2 * y[0] - 1)
        return weights
    places, values, owner = [], [], []
    for k, r in enumerate(rows):
        for kind in ("host", "path"):
            own = _features(kind, r[kind])
            places.append(own)
            values.append(np.full(len(own), 1 / np.sqrt(max(1, len(own)))))
            owner.append(np.full(len(own), k))
    places, values, owner = map(np.concatenate, (places, values, owner))
    for _ in range(rounds):
        z = np.bincount(owner, values * weights[places], len(y)) + weights[-1]
        error = 1 / (1 + np.exp(-z)) - y
        slope = np.bincount(places, values * error[owner], DIMENSIONS) / len(y)
        weights[:-1] -= 2.0 * (slope + 1e-3 * weights[:-1])
        weights[-1] -= 2.0 * error.mean()
    return weights


def _judge(weights: np.ndarray):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], float] = {}

        def score(kind: str, text: str) -> float:
            if (value := known.get((kind, text))) is None:
                if len(known) >= _REMEMBERED:
                    known.clear()
                value = known[kind, text] = _score(weights, kind, text)
            return value

        for batch in batches:
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            z = [score("host", h) + score("path", p) for h, p in zip(hosts, paths, strict=True)]
            chance = 1 / (1 + np.exp(-(np.array(z, float) + weights[-1])))
            columns = {c: batch[c] for c in batch.schema.names}
            yield pa.record_batch(columns | {"block_probability": pa.array(chance)})

    return judge


def judge_urls(
    pages: DataFrame, weights: np.ndarray, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5
) -> DataFrame:
    """Per page: host, path, rule, block_probability and verdict (the rule's, else the model's).

    `pages` has page_id and url; other columns are ignored. A null url, or one without `://`, has
    an empty host and path and is judged by the model like any other. A rule (host, slash, start of path)
    fits its host and all subdomains; the longest one wins. Rows are judged one by one
    where they are read, so nothing is shuffled and repeated hosts do not matter.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    kind = pages.schema["page_id"].dataType.simpleString()
    scored = parts.mapInArrow(
        _judge(weights), f"page_id {kind}, host string, path string, block_probability double"
    )
    scored = scored.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("block_probability") >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", own).alias("verdict"),
        "block_probability",
    )


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED), "url string, blocked boolean")

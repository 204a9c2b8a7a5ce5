"""Rejecting documents whose statistics are outliers of their language and source."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seektrail.llm.common import in_pieces, null_safe_join
from seektrail.plans.hot import stored

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Counted for the method only: distinct words, and words of at most three code points.
MORE = ("n_distinct", "n_short")
# Steps, lowest level and number of levels of the grid on which the transformed statistics are
# counted; what lies outside counts in the outermost level. A group has at most the product of the
# levels as cells, 240,000, however many documents it has.
STEPS = (0.8, 0.08, 0.08, 0.12, 0.8, 0.06)
LOWEST = (4, 15, 3, -9, 0, 0)
LEVELS = (10, 12, 10, 10, 5, 4)
# Differences that count as none in a statistic that is constant in a group, as symbols and repeats
# are in clean text: it has no variance to estimate. A statistic is constant if half of the
# group's documents lie within a tenth of this around the median; all others are left to the estimate.
TOLERANCES = (0.7, 0.08, 0.08, 0.1, 0.25, 0.035)
# Squared distance beyond which a document is rejected, once distances are scaled so that three
# quarters of the group's documents lie as a chi-square's do. The tails are longer than a
# chi-square's, as means over few words vary more than those of the group's usual lengths.
CUTOFF = 90.0
# Documents that a group's own estimate takes; smaller groups use that of the language, then all.
LEAST = 200
# The share of documents that the minimum-covariance-determinant estimate rests on.
COVERAGE = 0.75
STARTS = 8
# Added to each variance, as a share of it, so that matrices can be inverted.
RIDGE = 0.001
_P = len(STEPS)
# Chi-square quantiles 0.75 and 0.975 for one to six degrees of freedom.
_MOST_OF = (1.323, 2.773, 4.108, 5.385, 6.626, 7.841)
_NEARLY_ALL = (5.024, 7.378, 9.348, 11.143, 12.833, 14.449)


def _statistics(text: str) -> tuple[int, ...]:
    """The five counts of one whole text, and the two that only the method takes."""
    data = text.encode()
    words = data.split()  # at the space and the characters from tab to carriage return
    lengths = [len(w) for w in words] if data.isascii() else [len(w.decode()) for w in words]
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    again = 0
    for line in data.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    triples = list(zip(words, words[1:], words[2:], strict=False))
    covered = 0
    if len(set(triples)) < len(triples):
        counts, end = Counter(triples), 0
        for k, triple in enumerate(triples):
            if counts[triple] > 1:
                covered += k + 3 - max(k, end)
                end = k + 3
    short = sum(n <= 3 for n in lengths)
    return len(words), sum(lengths), symbols, again, covered, len(set(words)), short


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in in_pieces(batches, "text"):
        values = [_statistics(text or "") for text in piece["text"].to_pylist()]
        columns = np.array(values, np.int64).reshape(-1, len(COUNTS + MORE)).T
        kept = {c: piece[c] for c in piece.schema.names}
        counts = pa.StructArray.from_arrays([pa.array(c) for c in columns], list(COUNTS + MORE))
        yield pa.record_batch(kept | {"__q": counts})


def statistics(docs: DataFrame) -> DataFrame:
    """All columns, and `__q` with the counts of the whole text (null: none of anything)."""
    counts = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS + MORE])
    schema = T.StructType([*docs.schema.fields, T.StructField("__q", counts)])
    return docs.mapInArrow(_count, schema)


def base_failed() -> Column:
    few = F.col("__q.n_words") < 50
    return few | (100 * F.col("__q.n_repeat_words") > 50 * F.col("__q.n_words"))


def transformed() -> list[Column]:
    """The statistics on scales on which clean documents are roughly normal."""
    words = F.greatest(F.col("__q.n_words"), F.lit(1))
    return [
        F.log1p("__q.n_words"),
        F.log(F.greatest(F.col("__q.word_chars") / words, F.lit(0.05))),
        F.asin(F.sqrt(F.col("__q.n_short") / words)),
        F.log(F.greatest(F.col("__q.n_distinct"), F.lit(1)) / words),
        F.log1p(100 * F.col("__q.n_symbols") / words),
        F.greatest(F.col("__q.n_repeat_words"), 3 * F.col("__q.n_dup_lines")) / words,
    ]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(_P) for j in range(i, _P)]


def _moments(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the documents in the given cells."""
    total = n.sum()
    mean = s.sum(axis=0) / total
    square = np.zeros((_P, _P))
    for k, (i, j) in enumerate(_pairs()):
        square[i, j] = square[j, i] = q[:, k].sum() / total
    return mean, square - np.outer(mean, mean)


def _distances(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", (x - mean) @ np.linalg.inv(cov), x - mean)


def _weighted_quantile(values: np.ndarray, weights: np.ndarray, share: float) -> float:
    order = np.argsort(values, kind="stable")
    return values[order][np.searchsorted(np.cumsum(weights[order]), share * weights.sum())]


def _ridged(cov: np.ndarray, tolerances: np.ndarray) -> np.ndarray:
    return cov + np.diag(RIDGE * np.diag(cov) + (tolerances / 1000) ** 2)


def minimum_covariance(
    n: np.ndarray, s: np.ndarray, q: np.ndarray, tolerances: np.ndarray, coverage: float = COVERAGE
) -> tuple[np.ndarray, np.ndarray]:
    """Reweighted minimum-covariance-determinant estimate from the cells of one group.

    A cell has its number of documents, their sums and sums of products, so the mean and covariance
    of any set of cells is that of their documents. From each of several starts, the nearest cells
    with the wanted share of the documents give the next estimate until it stays the same
    (concentration steps); the smallest determinant wins. It is scaled to the distances of the
    covered share, computed once more from all documents within the 0.975 quantile, and scaled again.
    Constant statistics have their tolerance as deviation and go with no other.
    """
    x, total = s / n[:, None], n.sum()
    middle = np.array([_weighted_quantile(x[:, k], n, 0.5) for k in range(_P)])
    spread = np.array([_weighted_quantile(abs(x[:, k] - middle[k]), n, 0.5) for k in range(_P)])
    starts = [(middle, np.diag(np.maximum(1.4826 * spread, tolerances / 10) ** 2))]
    random = np.random.default_rng(7)
    for _ in range(STARTS - 1):
        size = min(len(n), 4 * (_P + 1))
        some = random.choice(len(n), size=size, replace=False, p=n / total)
        starts.append(_moments(n[some], s[some], q[some]))
    best = None
    for mean, cov in starts:
        chosen = None
        for _ in range(50):
            order = np.argsort(_distances(x, mean, _ridged(cov, tolerances)), kind="stable")
            upto = np.searchsorted(np.cumsum(n[order]), coverage * total) + 1
            now = np.sort(order[:upto])
            if chosen is not None and np.array_equal(now, chosen):
                break
            chosen = now
            mean, cov = _moments(n[now], s[now], q[now])
        size = np.linalg.slogdet(_ridged(cov, tolerances))[1]
        if best is None or size < best[0] - 1e-12:
            best = size, mean, cov
    _, mean, cov = best
    varies = spread > tolerances / 10
    for last in (False, True):
        cov = np.where(np.outer(varies, varies), cov, 0)
        free = max(1, int(varies.sum()))
        cov = _ridged(cov, tolerances)
        cov[~varies, ~varies] = tolerances[~varies] ** 2
        distances = _distances(x, mean, cov)
        scale = max(1.0, _weighted_quantile(distances, n, 0.75) / _MOST_OF[free - 1])
        cov[np.outer(varies, varies)] *= scale
        if not last:
            near = distances <= _NEARLY_ALL[free - 1] * scale
            mean, cov = _moments(n[near], s[near], q[near])
    return mean, cov


def _estimate(cells: pd.DataFrame) -> pd.DataFrame:
    cells = cells.sort_values([f"c{k}" for k in range(_P)], kind="stable")
    n = cells["n"].to_numpy(float)
    s = cells[[f"s{k}" for k in range(_P)]].to_numpy(float)
    q = cells[[f"q{i}{j}" for i, j in _pairs()]].to_numpy(float)
    mean, cov = minimum_covariance(n, s, q, np.array(TOLERANCES))
    white = np.linalg.inv(np.linalg.cholesky(cov))
    return pd.DataFrame({"lang": [cells["lang"].iloc[0]], "source": [cells["source"].iloc[0]],
                         "level": [cells["level"].iloc[0]], "mean": [mean.tolist()],
                         "white": [white.ravel().tolist()]})


def robust_estimates(stats: DataFrame, least: int = LEAST) -> DataFrame:
    """Centre and whitening matrix per (lang, source), per lang and over all, as `level` 0, 1, 2.

    Only groups with at least `least` documents have one. Documents are summed up per cell of a
    grid before anything is shuffled; a group's cells, whose number is bounded, meet in one task.
    """
    x = transformed()
    level = [
        F.least(
            F.greatest(F.floor(x[k] / STEPS[k]) - LOWEST[k], F.lit(0)), F.lit(LEVELS[k] - 1)
        ).alias(f"c{k}")
        for k in range(_P)
    ]
    values = stats.filter(~base_failed()).select(
        "lang", "source", *level, *[c.alias(f"x{k}") for k, c in enumerate(x)]
    )
    places = [f"c{k}" for k in range(_P)]
    sums = [f"s{k}" for k in range(_P)] + [f"q{i}{j}" for i, j in _pairs()]
    cells = values.groupBy("lang", "source", *places).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"x{k}").alias(f"s{k}") for k in range(_P)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in _pairs()],
    )
    cells = stored(cells, "cells")
    add = [F.sum(c).alias(c) for c in ("n", *sums)]
    nothing = F.lit(None).cast("string")
    levels = [
        cells.withColumn("level", F.lit(0)),
        cells.groupBy("lang", *places).agg(*add).withColumns({"source": nothing, "level": F.lit(1)}),
        cells.groupBy(*places).agg(*add).withColumns({"lang": nothing, "source": nothing, "level": F.lit(2)}),
    ]
    every = levels[0].unionByName(levels[1]).unionByName(levels[2])
    large = every.groupBy("level", "lang", "source").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= least)
    every = null_safe_join(every, large.drop("docs"), ["level", "lang", "source"], "left_semi")
    return every.groupBy("level", "lang", "source").applyInPandas(
        _estimate, "lang string, source string, level int, mean array<double>, white array<double>"
    )


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST) -> DataFrame:
    """Per document: five counts, base_failed, distance and kept.

    `docs` has doc_id (long), and text, lang and source (strings); other columns are ignored, also such
    as have names of result columns. Null texts and texts without words fail the base rule. Null lang and
    source are values of their own. A document is kept if it passes the base rule (50 words or
    more, at most half of them in repeated 3-word windows) and its squared Mahalanobis distance from
    the robust estimate of its language and source is at most `cutoff`. Groups with under
    `least` documents use the estimate of the language, or else of all; with fewer still, only
    the base rule holds and distance is null. Equal rows have equal results. An empty table gives
    an empty result. Texts are counted whole, whatever their length. Runs jobs while called.
    """
    judged = _judged(docs.select("doc_id", "text", "lang", "source"), False, least)
    return judged.select(
        "doc_id",
        *[f"__q.{c}" for c in COUNTS],
        base_failed().alias("base_failed"),
        F.col("__distance").alias("distance"),
        _passes(cutoff).alias("kept"),
    )


def drop_outliers(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST) -> DataFrame:
    """The rows of `docs` that `quality_rules` keeps, with all their columns."""
    return _judged(docs, True, least).filter(_passes(cutoff)).select(*docs.columns)


def _passes(cutoff: float) -> Column:
    return ~base_failed() & F.coalesce(F.col("__distance") <= cutoff, F.lit(True))


def _judged(docs: DataFrame, texts: bool, least: int) -> DataFrame:
    """All columns (text only if `texts`), the counts `__q`, and `__distance`."""
    counted = statistics(docs)
    stats = stored(counted if texts else counted.drop("text"), "statistics")
    found = stored(robust_estimates(stats, least), "estimates")
    for level, keys in enumerate((["lang", "source"], ["lang"], [])):
        own = found.filter(F.col("level") == level).select(*keys, F.struct("mean", "white").alias(f"__e{level}"))
        if keys:
            stats = null_safe_join(stats, own, keys, "left")
        else:  # one row or none
            stats = stats.join(F.broadcast(own), F.lit(True), "left")
    stats = stats.withColumn("__e", F.coalesce("__e0", "__e1", "__e2"))
    x = transformed()
    centred = [x[k] - F.col("__e.mean")[k] for k in range(_P)]
    distance = F.lit(0.0)
    for i in range(_P):
        turned = F.lit(0.0)
        for j in range(i + 1):
            turned = turned + F.col("__e.white")[i * _P + j] * centred[j]
        distance = distance + turned * turned
    return stats.withColumn("__distance", distance)

"""Ordinal cumulative-link regression of graded quality on hashed text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seektrail.llm.common import in_pieces
from seektrail.plans.hot import stored

DIMENSIONS = 1 << 18
# Rated documents that the regression is fitted on.
FIT_ROWS = 4_000
# Rated documents that a feature must occur in to have a weight, and how many standard deviations
# its share of some grade or better must be from that of all documents. Other words are noise.
LEAST_DOCS = 4
DEVIATIONS = 4.5
_SYMBOLS = b"#*$%&|<>@={}[]\\^~_"
# Lower case for A-Z, a space for punctuation.
_PLAIN = bytes(32 if c in b".,;:!?()\"'/-" + _SYMBOLS else c + 32 * (65 <= c <= 90) for c in range(256))
_UPPER = bytes(range(65, 91))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade >= k) is the logistic function of the text's score minus thresholds[k - 1]."""

    weights: np.ndarray
    thresholds: np.ndarray


def _level(share: float) -> int:
    return min(9, int(10 * share))


def features(text: str | None) -> np.ndarray:
    """Places of the distinct features of a whole text: its words and a few of its shape.

    Words are taken without punctuation and case. The shape features are hashed like words: tenths
    of capital letters, of symbols, of repeated lines and of distinct words, and the magnitude of the length.
    """
    data = (text or "").encode()
    words = data.translate(_PLAIN).split()
    kinds = set(words)
    size = max(1, len(data))
    lines = [x for x in data.split(b"\n") if x.strip()]
    shape = (
        b"\0upper%d" % _level((size - len(data.translate(None, _UPPER))) / size),
        b"\0symbol%d" % _level(5 * (size - len(data.translate(None, _SYMBOLS))) / size),
        b"\0again%d" % _level(1 - len(set(lines)) / max(1, len(lines))),
        b"\0kinds%d" % _level(len(kinds) / max(1, len(words))),
        b"\0length%d" % len(words).bit_length(),
    )
    places = {zlib.crc32(w) % DIMENSIONS for w in kinds}
    places.update(zlib.crc32(w) % DIMENSIONS for w in shape)
    return np.fromiter(places, np.int64, len(places))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in in_pieces(batches, "text"):
        rows = [np.sort(features(t)).astype(np.int32).tobytes() for t in piece["text"].to_pylist()]
        yield pa.record_batch({"grade": piece["grade"], "places": pa.array(rows, pa.binary())})


def _telling(rows: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """Which features are frequent enough and go along with the grade."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    places, n = np.concatenate(rows), len(rows)
    docs = np.bincount(places, minlength=DIMENSIONS).astype(float)
    best = np.zeros(DIMENSIONS)
    for k in range(1, int(grades.max()) + 1):
        better = grades >= k
        share = better.mean()
        seen = np.bincount(places, better[owner].astype(float), DIMENSIONS)
        spread = np.sqrt(docs * share * (1 - share) * (1 - docs / n))
        best = np.maximum(best, abs(seen - docs * share) / np.maximum(spread, 1e-9))
    return (docs >= LEAST_DOCS) & (docs < n) & (best >= DEVIATIONS)


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, rounds: int = 300, ridge: float = 1e-5, rate: float = 0.1
) -> OrdinalModel:
    """Maximum likelihood with a ridge, by gradient descent with adapted steps (Adam).

    Grades count from 0. Thresholds stay in order as each is the one before plus a positive step.
    With fewer than two grades all weights are 0.
    """
    top = int(grades.max(initial=0))
    if len(set(grades.tolist())) < 2:
        return OrdinalModel(np.zeros(DIMENSIONS), np.zeros(max(1, top)))
    lengths = np.array([len(r) for r in rows])
    places, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), lengths)
    used = _telling(rows, grades)
    keep = used[places]
    places, owner = places[keep], owner[keep]
    index = np.cumsum(used) - 1
    places, n, size = index[places], len(rows), int(used.sum())
    # The start: no weights, and thresholds that give the grades their shares.
    shares = np.array([(grades >= k).mean() for k in range(1, top + 1)]).clip(1e-3, 1 - 1e-3)
    theta = np.maximum.accumulate(-np.log(shares / (1 - shares)) + 1e-3 * np.arange(top))
    steps = np.log(np.maximum(np.diff(theta), 1e-3))
    x = np.concatenate([np.zeros(size), theta[:1], steps])
    first, second = np.zeros_like(x), np.zeros_like(x)
    lower, upper = grades - 1, grades
    for t in range(1, rounds + 1):
        theta = x[size] + np.concatenate([[0.0], np.cumsum(np.exp(x[size + 1 :]))])
        score = np.bincount(owner, x[places], n)
        tails = 1 / (1 + np.exp(-(score[:, None] - theta)))
        tails = np.hstack([np.ones((n, 1)), tails, np.zeros((n, 1))])
        chance = np.maximum(tails[np.arange(n), grades] - tails[np.arange(n), grades + 1], 1e-12)
        slopes = tails * (1 - tails)
        up, down = slopes[np.arange(n), grades], slopes[np.arange(n), grades + 1]
        by_score = -(up - down) / chance / n
        by_theta = np.zeros(top)
        some, many = lower >= 0, upper < top
        np.add.at(by_theta, lower[some], (up / chance / n)[some])
        np.add.at(by_theta, upper[many], -(down / chance / n)[many])
        slope = np.concatenate(
            [
                np.bincount(places, by_score[owner], size) + ridge * x[:size],
                [by_theta.sum()],
                [by_theta[k + 1 :].sum() * np.exp(x[size + 1 + k]) for k in range(top - 1)],
            ]
        )
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        x -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(DIMENSIONS)
    weights[used] = x[:size]
    theta = x[size] + np.concatenate([[0.0], np.cumsum(np.exp(x[size + 1 :]))])
    return OrdinalModel(weights, theta)


def train(docs: DataFrame, ratings: DataFrame, fit_rows: int = FIT_ROWS) -> OrdinalModel:
    """Fit on at most `fit_rows` rated documents, chosen by a hash of doc_id.

    `ratings` has doc_id and grade (0, 1, 2, ...); nulls are left out. A document with several ratings
    has the lowest. Its features come to the driver as numbers.
    """
    rated = ratings.filter("doc_id is not null and grade is not null")
    rated = rated.groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = stored(rated.orderBy(F.xxhash64(F.lit(9), "doc_id"), "doc_id").limit(fit_rows), "rated")
    # At most fit_rows rows of two numbers.
    texts = docs.select("doc_id", F.col("text").cast("string")).filter("text is not null")
    texts = texts.join(F.broadcast(chosen), "doc_id").select("text", "grade")
    found = texts.mapInArrow(_featurize, "grade int, places binary").collect()
    found = sorted(found)
    rows = [np.frombuffer(r["places"], np.int32).astype(np.int64) for r in found]
    return fit_ordinal(rows, np.array([r["grade"] for r in found], np.int64))


def _rate(model: OrdinalModel, at_least: int):
    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text"):
            score = np.array([model.weights[features(t)].sum() for t in piece["text"].to_pylist()])
            tails = 1 / (1 + np.exp(-(score[:, None] - model.thresholds)))
            tail = tails[:, at_least - 1] if at_least <= tails.shape[1] else np.zeros(len(score))
            kept = {c: piece[c] for c in piece.schema.names if c != "text"}
            yield pa.record_batch(
                kept
                | {
                    "expected_grade": pa.array(tails.sum(axis=1)),
                    "tail_probability": pa.array(tail),
                }
            )

    return rate


def classify(docs: DataFrame, model: OrdinalModel, at_least: int, threshold: float = 0.5) -> DataFrame:
    """Per document: expected_grade, tail_probability of a grade of `at_least` or more, and kept.

    `docs` has doc_id and text; other columns are ignored. A null text is an empty one. A
    document is kept if its tail probability is at least `threshold`. Equal texts have equal results; an
    empty table gives an empty result. Rows are judged where they are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rated = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _rate(model, at_least), f"doc_id {kind}, expected_grade double, tail_probability double"
    )
    return rated.withColumn("kept", F.col("tail_probability") >= threshold)


def grades(labels: DataFrame) -> DataFrame:
    """Grades from the tables' labels: 0 poor quality, 1 good but toxic, 2 good and not toxic."""
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    grade = F.when(~good, 0).when(good & ~clean, 1).when(good & clean, 2)
    return labels.select("doc_id", grade.alias("grade"))

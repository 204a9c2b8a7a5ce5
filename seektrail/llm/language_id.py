"""Language identification: the family first, then one-versus-one machines within it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from seektrail.llm.common import in_pieces, mix, utf8
from seektrail.plans.hot import stored

UNKNOWN = "und"
# Language families by code; a language that is not listed is a family of its own. Fixed values.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic",
    "sv": "germanic", "ca": "romance", "es": "romance", "fr": "romance", "it": "romance",
    "pt": "romance", "ro": "romance", "cs": "slavic", "pl": "slavic", "ru": "slavic",
    "sk": "slavic", "uk": "slavic",
}
# Documents that the machines are fitted on, shared equally by the languages.
FIT_ROWS = 1_200
# Places for the hashed n-grams of one, two and three bytes.
SIZES = (256, 4_096, 8_192)
_OFFSETS = tuple(int(x) for x in np.cumsum((0, *SIZES)))
_PIECE = 1 << 18
# What bytes of UTF-8 are folded to: letters of ASCII in lower case and all bytes beyond ASCII;
# anything else is a space. _FOLD has the number in _FOLDED of each byte.
_FOLDED = np.array([32, *range(97, 123), *range(128, 256)], np.uint64)
_FOLD = np.zeros(256, np.int64)
_FOLD[65:91] = _FOLD[97:123] = np.arange(1, 27)
_FOLD[128:] = np.arange(27, 155)


@dataclass(frozen=True)
class Machine:
    """A linear machine that prefers `first` where positive, else `second`."""

    first: str
    second: str
    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    languages: Mapping[str, tuple[str, ...]]
    between_families: tuple[Machine, ...]
    within: Mapping[str, tuple[Machine, ...]]


@cache
def _place_of(n: int) -> np.ndarray:
    """The place of every possible n-gram of folded bytes among all features."""
    if n == 1:
        return _FOLDED.astype(np.int16)
    rest = np.zeros(1, np.uint64)
    for _ in range(n - 1):
        rest = np.add.outer(rest * np.uint64(256), _FOLDED).ravel()
    first = _FOLDED << np.uint64(8 * (n - 1))
    places = [mix(x + rest) % np.uint64(SIZES[n - 1]) + np.uint64(_OFFSETS[n - 1]) for x in first]
    return np.concatenate(places).astype(np.int16)


def _grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1, 2, ...: places of n-grams, and per text its first n-gram and the one after its last.

    N-grams that begin in one text and end in another, or past the last, are there but in no text.
    """
    data, limits = utf8(texts)
    folded = np.append(_FOLD.take(data), np.zeros(len(SIZES), np.int64))
    codes = np.zeros(len(folded) + 1, np.int64)
    for n in range(1, len(SIZES) + 1):
        codes = codes[:-1] * len(_FOLDED) + folded[n - 1 :]
        # All codes have a place: `clip` only spares NumPy a look for codes that have none.
        yield _place_of(n).take(codes, mode="clip"), limits[:-1], np.maximum(limits[1:] - n + 1, limits[:-1])


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of values[start:end] for each text, which depends on these values alone."""
    sums = np.add.reduceat(values, np.stack([starts, ends], axis=1).ravel())[::2]
    return np.where(ends > starts, sums, 0.0)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Relative frequencies of the n-grams of every whole text, as 32-bit floats."""
    for piece in in_pieces(batches, "text", _PIECE):
        out = np.zeros((piece.num_rows, _OFFSETS[-1]), np.float32)
        for places, starts, ends in _grams(piece["text"]):
            for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
                if b > a:
                    out[k] += np.bincount(places[a:b], minlength=_OFFSETS[-1]) / (b - a)
        yield pa.record_batch(
            {
                "lang": piece["lang"],
                "vector": pa.array([row.tobytes() for row in out], pa.binary()),
            }
        )


def support_vectors(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60):
    """Weights and bias of a linear support vector machine (labels 1 and -1), by dual ascent.

    The bias is that of a constant feature; labels weigh the same however many rows they have.
    """
    gram = x @ x.T + 1.0
    caps = np.where(y > 0, len(y) / max(1, (y > 0).sum()), len(y) / max(1, (y < 0).sum())) * cost
    alpha = np.zeros(len(y))
    output = np.zeros(len(y))
    order = np.random.default_rng(5)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            step = (1 - y[i] * output[i]) / gram[i, i]
            new = min(max(alpha[i] + step, 0.0), caps[i])
            if new != alpha[i]:
                output += (new - alpha[i]) * y[i] * gram[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return x.T @ (alpha * y), float((alpha * y).sum())


def _versus(x: np.ndarray, names: np.ndarray) -> tuple[Machine, ...]:
    machines = []
    for first, second in combinations(sorted(set(names.tolist())), 2):
        own = (names == first) | (names == second)
        y = np.where(names[own] == first, 1.0, -1.0)
        machines.append(Machine(first, second, *support_vectors(x[own], y)))
    return tuple(machines)


def _lowest(docs: DataFrame, most: int) -> DataFrame:
    """The `most` documents of each language with the lowest hashes, numbered as `place`."""
    ids = docs.select("doc_id", "lang", F.xxhash64(F.lit(3), "doc_id").alias("dice"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("dice", "doc_id"))
    return ids.withColumn("place", place).filter(F.col("place") <= most)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, families: Mapping[str, str] = FAMILIES) -> Model:
    """Fit on (doc_id, text, lang): at most `fit_rows` documents, equally many per language.

    A single language has nothing to be told from and gets half of them. Which ones is decided by a
    hash of doc_id. Rows with a null lang or text are left out. Their n-gram frequencies come to the
    driver, 50 kB each. No rows give a model that knows nothing.
    """
    docs = docs.filter("lang is not null and text is not null and trim(text) <> ''")
    first = stored(_lowest(docs, max(1, fit_rows // 2)), "first")
    languages = first.select("lang").distinct().count()
    chosen = first.filter(F.col("place") <= max(1, fit_rows // max(2, languages)))
    # At most fit_rows rows of two numbers and a code.
    sample = docs.join(F.broadcast(chosen.select("doc_id", "lang").distinct()), ["doc_id", "lang"], "left_semi")
    rows = sample.select("text", "lang").mapInArrow(_vectors, "lang string, vector binary").collect()
    rows = sorted(rows)
    names = np.array([r["lang"] for r in rows], object)
    x = np.array([np.frombuffer(r["vector"], np.float32) for r in rows])
    x = 30 * x.reshape(len(rows), _OFFSETS[-1])
    family = np.array([families.get(n, n) for n in names], object)
    known = tuple(sorted(set(family.tolist())))
    return Model(
        known,
        {f: tuple(sorted(set(names[family == f].tolist()))) for f in known},
        _versus(x, family),
        {f: _versus(x[family == f], names[family == f]) for f in known},
    )


def _choose(names: tuple[str, ...], machines: tuple[Machine, ...], margins: np.ndarray):
    """The name with the most votes, equal ones by their summed margins; and how sure that is."""
    if len(names) == 1:
        return np.zeros(len(margins), np.int64), np.ones(len(margins))
    votes = np.zeros((len(margins), len(names)))
    least = np.full((len(margins), len(names)), np.inf)
    for k, m in enumerate(machines):
        a, b = names.index(m.first), names.index(m.second)
        votes[:, a] += (margins[:, k] > 0) + 1e-3 * np.tanh(margins[:, k])
        votes[:, b] += (margins[:, k] <= 0) - 1e-3 * np.tanh(margins[:, k])
        least[:, a] = np.minimum(least[:, a], margins[:, k])
        least[:, b] = np.minimum(least[:, b], -margins[:, k])
    best = votes.argmax(axis=1)
    return best, 1 / (1 + np.exp(-3 * least[np.arange(len(best)), best]))


def _predict(model: Model):
    machines = [*model.between_families, *(m for f in model.families for m in model.within[f])]
    weights = np.array([m.weights for m in machines], np.float64).reshape(len(machines), _OFFSETS[-1])
    weights, bias = 30 * weights, np.array([m.bias for m in machines])
    first, spans = len(model.between_families), {}
    for f in model.families:
        spans[f] = slice(first, first + len(model.within[f]))
        first += len(model.within[f])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in in_pieces(batches, "text", _PIECE):
            margins = np.tile(bias, (piece.num_rows, 1))
            for places, starts, ends in _grams(piece["text"]):
                places, counts = places.astype(np.intp), np.maximum(ends - starts, 1)
                for c in range(len(machines)):
                    margins[:, c] += _sums(weights[c].take(places, mode="clip"), starts, ends) / counts
            langs = np.full(piece.num_rows, UNKNOWN, object)
            score = np.zeros(piece.num_rows)
            some = pc.fill_null(pc.match_substring_regex(piece["text"], "[A-Za-z]"), False)
            some = some.to_numpy(zero_copy_only=False).copy()
            for k in np.flatnonzero(~some):
                some[k] = any(map(str.isalpha, piece["text"][k].as_py() or ""))
            if model.families:
                between = margins[:, : len(model.between_families)]
                best, sure = _choose(model.families, model.between_families, between)
                for k, f in enumerate(model.families):
                    own = np.flatnonzero(some & (best == k))
                    names = model.languages[f]
                    which, surer = _choose(names, model.within[f], margins[own, spans[f]])
                    langs[own] = np.array(names, object)[which]
                    score[own] = sure[own] * surer
            kept = {c: piece[c] for c in piece.schema.names if c != "text"}
            yield pa.record_batch(kept | {"lang_pred": pa.array(langs, pa.string()), "score": pa.array(score)})

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: lang_pred and score (0 to 1), from its whole text alone.

    `docs` has doc_id and text; other columns are ignored, lang and source too. A null text,
    or one without a letter, is `und` with score 0, as is every text if the model knows nothing. Equal texts
    have equal results; an empty table gives an empty result. Rows are judged where they are read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _predict(model), f"doc_id {kind}, lang_pred string, score double"
    )


def held_out(docs: DataFrame) -> DataFrame:
    """Add held_out: the third of the documents that a test model must not learn from."""
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    return docs.withColumn("held_out", remainder == 1)

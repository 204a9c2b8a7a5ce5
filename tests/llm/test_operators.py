"""The dealt operators on odd inputs and against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seektrail.llm import (
    language_id,
    mixing,
    neighbours,
    packing,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    token_counts,
    url_filter,
)
from seektrail.llm.common import mix, packed
from seektrail.llm.components import components
from seektrail.llm import near_duplicates as near_duplicates_module
from seektrail.llm.near_duplicates import near_duplicates
from seektrail.llm.suffix_array import permuted_prefixes, suffix_array
from seektrail.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Extra columns have names that results and helpers use.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, n int,"
    " kept string, taken string, size string, key int, score string, n_words string"
)


def text_of(seed, words=120):
    random = np.random.default_rng(seed)
    return " ".join("".join(random.choice(list("abcdeé"), 6)) for _ in range(words))


def odd_rows():
    long = text_of(1, 4000)
    near = text_of(2)
    rows = [
        (1, near, "en", "a"), (2, near + " zzz", "en", "a"), (3, near, "en", None),
        (3, near, "en", None), (4, None, None, "b"), (5, "", "fr", "b"), (6, " \n\t ", "fr", None),
        (7, long, "de", "c"), (8, "x" + long[:9000] + "y", "de", "c"), (9, "one two", "es", "a"),
        (10, "ab" * 300, None, None), (None, text_of(3), "en", "a"), (None, near, None, "a"),
        (11, text_of(4) + "\n" + near[:300], "en", "b"), (12, "123 456", "en", "d"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), 7, 7, "k", "t", "s", 7, "x", "w") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def brute_removed(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = text.encode()
        gone = np.zeros(len(data) + 1, int)
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                gone[s : s + length] = 1
            seen.add(window)
        left = bytes(b for b, g in zip(data, gone) if not g)
        runs = int((np.diff(np.r_[0, gone]) == 1).sum())
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())
    return out


def test_suffix_arrays_and_prefixes():
    random = np.random.default_rng(1)
    for trial in range(300):
        data = random.integers(0, random.integers(1, 5), random.integers(0, 50)).astype(np.uint8)
        if trial % 3 == 0:
            data = np.tile(data, 3)
        raw = data.tobytes()
        order = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert suffix_array(data).tolist() == order
        prefixes = [0] * len(raw)
        for a, b in zip(order, order[1:]):
            while max(a, b) + prefixes[b] < len(raw) and raw[a + prefixes[b]] == raw[b + prefixes[b]]:
                prefixes[b] += 1
        assert permuted_prefixes(data, np.array(order, int)).tolist() == prefixes


@pytest.mark.parametrize("shard_bytes", [1 << 20, 2_000])
def test_repeated_passages_equal_brute_force(documents, shard_bytes):
    rows = [(r["doc_id"], r["text"] or "") for r in documents.collect()]
    found = suffix_dedup.suffix_dedup(documents, shard_bytes=shard_bytes).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == brute_removed(rows, 100)


def test_repeated_passages_of_odd_rows(odd):
    rows = suffix_dedup.suffix_dedup(odd).collect()
    assert len(rows) == odd.count()
    found = {r["doc_id"]: r for r in rows}
    assert found[4]["n_bytes"] == found[5]["n_removed"] == 0
    assert found[8]["n_removed"] > 8000 and found[10]["n_removed"] == 598
    assert found[3]["n_removed"] == found[3]["n_bytes"]
    cleaned = suffix_dedup.remove_repeated(odd)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count()
    assert suffix_dedup.suffix_dedup(odd.limit(0)).count() == 0
    assert suffix_dedup.remove_repeated(odd.limit(0)).count() == 0


def templated(seed, lines):
    random = np.random.default_rng(seed)
    return "".join(f"2026-11-30 request to the search service, item {n} done\n" for n in random.integers(0, 1 << 40, lines))


def test_hot_passages_beyond_places_of_24_bits():
    half = templated(1, 60_000).encode()
    text = np.frombuffer(half + half, np.uint8)
    found = []
    for a in range(0, len(text), 1 << 20):
        part = text[a : a + (1 << 20) + 99]
        _, start, windows, grams, _ = suffix_dedup.segments(part, np.array([0, len(part)]), 100, 20)
        found += [
            {"gram": g, "start": a + s, "windows": n, "parts": 2}
            for g, s, n in zip(grams.view(np.int64).tolist(), start.tolist(), windows.tolist())
        ]
    assert sum(x["windows"] + 99 for x in found) > 1 << 24
    size, value = packed(pa.array([text.tobytes().decode()]))
    batch = pa.record_batch({
        "id": pa.array([1]), "v": pa.array([0]), "size": size, "packed": value, "found": pa.array([found]),
    })
    hot = {0: {}, 1: {}}
    for out in suffix_dedup._cut_out(100, 20)([batch]):
        for row in out.to_pylist():
            for k in range(len(row["bytes"]) - 99):
                copy, place = divmod(row["start"] + k, len(half))
                hot[copy][place] = row["gram"]
    inner = range(0, len(half) - 99, 997)
    assert [hot[0].get(k) for k in inner] == [hot[1].get(k) for k in inner]
    assert None not in {hot[0].get(k) for k in inner}
    with pytest.raises(ValueError):
        suffix_dedup.segments(np.zeros((1 << 24) + 1, np.uint8), np.array([0, (1 << 24) + 1]), 100, 20)


@pytest.mark.parametrize("reach", [500, 2 << 20])
def test_repeated_passages_of_a_long_templated_document(spark, reach):
    long = templated(2, 600)
    rows = [(1, long + long[5_000:9_000]), (2, templated(3, 20) + long[20_000:20_900])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = suffix_dedup.suffix_dedup(df, shard_bytes=2_000, reach=reach).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in found} == brute_removed(rows, 100)


@pytest.mark.parametrize("first", [0, None])
def test_passages_of_repeated_rows_stay_once(spark, first):
    # The gram of the shared passage occurs with other content too, so it is looked at in a shard.
    random = np.random.default_rng(6)
    words = ["".join(random.choice(list("abcdefgh"), 7)) for _ in range(400)]
    own, other, more = (" ".join(words[k : k + 60]) for k in (0, 100, 200))
    texts = [own, other + own[30:230] + more, more[:200] + own[100:330] + other[:250]]
    rows = [(first, texts[0]), (first, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = suffix_dedup.suffix_dedup(df).collect()
    once = brute_removed([(k, t) for k, t in enumerate(texts)], 100)
    assert len(found) == 5
    assert all(tuple(r)[1:] == once[0 if r["doc_id"] is None else r["doc_id"]] for r in found)
    cleaned = {r["text"] for r in suffix_dedup.remove_repeated(df).collect()}
    assert own in cleaned and len(cleaned) == 3


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute_components(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("limits", [{}, {"block_rows": 3, "block_bytes": 3_000}])
def test_near_duplicates_equal_brute_force(spark, limits):
    random = np.random.default_rng(4)
    base = text_of(9, 150).split()
    texts = []
    for _ in range(40):
        words = list(base)
        for k in random.integers(0, 150, random.integers(0, 6)):
            words[k] = f"w{random.integers(1000)}"
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts + texts[:3] + ["A b", "a B", "", None])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, **limits).collect()}
    assert found == brute_components(rows)


def test_near_duplicates_of_odd_rows(odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    found = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert found[2]["component_id"] == found[3]["component_id"] == 1
    assert found[4]["kept"] and found[5]["n_shingles"] == 0 and not found[3]["kept"]
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert near_duplicates(odd.limit(0)).count() == 0


def test_pipeline_stage_drops_near_duplicates_from_80_percent(spark):
    words = text_of(9, 150).split()
    near, apart = list(words), list(words)
    for k in (30, 75, 120):
        near[k] = f"w{k}"
    for k in (20, 50, 80, 110):
        apart[k] = f"v{k}"
    a, b, c = (shingles(" ".join(x)) for x in (words, near, apart))
    assert 0.80 < len(a & b) / len(a | b) < 0.85 and len(a & c) / len(a | c) < 0.80
    rows = [(k, " ".join(x)) for k, x in enumerate((words, near, apart))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == [0, 2]


def test_rows_that_share_an_id_are_dropped_one_by_one(spark):
    a, b, c = text_of(31), text_of(32), text_of(33)
    rows = [(1, a), (5, a), (5, b), (5, b), (5, None), (5, None), (6, b + " x"), (6, c), (None, a), (None, a), (7, ""), (8, "")]
    df = spark.createDataFrame([(*r, "x", 3, 4) for r in rows], "doc_id bigint, text string, h string, n int, component int")
    left = near_duplicates_module.drop_near_duplicates(df.repartition(4))
    assert left.columns == df.columns
    expected = Counter([(1, a), (5, b), (5, None), (6, c), (None, a), (7, ""), (8, "")])
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == expected
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect()}
    assert {(5, 116, 1), (5, 116, 5), (6, 117, 5), (6, 116, 6)} <= found
    assert near_duplicates_module.drop_near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_bands_follow_the_threshold(percent):
    count = near_duplicates_module.band_count(percent)
    assert 120 % count == 0 and (1 - (percent / 100) ** (120 // count)) ** count < 1e-6
    assert {80: 30, 85: 24}.get(percent, count) == count


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["id"]: r["component"] for r in found} == {
        **{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)},
    }


def test_encoder_gives_the_ids_of_the_json_vocabulary(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r["text"] for r in documents.select("text").collect()]
    texts += ["", "  a\n \n b\t x", "naïve 日本語 🙂 don't 1234", " lead", "trail \n"]
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in Encoder().ids(texts)] == expected


def test_names_of_special_tokens_are_ordinary_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True  # as the vocabulary's README says
    texts = ["<|endoftext|>", "one <|endoftext|> two", "one<|endoftext|>two", "<|endoftext|><|endoftext|>\n"]
    expected = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in Encoder().ids(texts)] == expected


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_plan_equals_best_fit_piece_by_piece(score):
    random = np.random.default_rng(2)
    for _ in range(60):
        capacity = packing.Capacity(int(random.integers(5, 40)), int(random.integers(1, 8)), 900)
        lengths = random.choice(np.arange(1, min(capacity.tokens, 30) + 1), 4, replace=False)
        histogram = {int(n): int(random.integers(1, 9)) for n in lengths}
        limits, bins = np.array([capacity.tokens, capacity.pieces, capacity.attention], float), []
        for n in sorted(histogram, reverse=True):
            need = np.array([n, 1, n * n], float)
            for _ in range(histogram[n]):
                fits = [k for k, b in enumerate(bins) if (b >= need).all()]
                if score == "norm":
                    cost = {k: round((((bins[k] - need) / limits) ** 2).sum(), 12) for k in fits}
                else:
                    cost = {k: round(((need / limits) * (bins[k] / limits)).sum(), 12) for k in fits}
                if fits:
                    bins[min(fits, key=cost.get)] -= need
                else:
                    bins.append(limits - need)
        assert packing.plan_packing(histogram, capacity, score).sequences == len(bins)


def test_packing_of_odd_rows(odd):
    rows = packing.pack(odd, bucket_rows=4).toPandas()
    ids = list(Encoder().ids([r[1] for r in odd_rows()], 0))
    assert rows["length"].sum() == sum(map(len, ids)) and rows["length"].max() <= 2048
    assert Counter(rows["doc_id"].dropna().astype(int))[3] == 2
    rows = rows.sort_values(["sequence_id", "offset"])
    before = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
    assert (before == rows["offset"]).all()
    long = next(i for i, r in zip(ids, odd_rows()) if r[0] == 7)
    for r in rows[rows["doc_id"] == 7].itertuples():
        assert r.ids_crc32 == zlib.crc32(long[r.start : r.start + r.length].tobytes())
    assert packing.pack(odd.limit(0)).count() == 0


def test_token_counts(odd):
    sizes = np.array([len(i) for i in Encoder().ids([r[1] for r in odd_rows()])])
    histogram = token_counts.length_histogram(odd).collect()
    assert {r["length"]: r["docs"] for r in histogram} == Counter(sizes.tolist())
    for r in histogram:
        n = r["length"]
        assert r["docs_at_least"] == (sizes >= n).sum() and r["tokens_at_least"] == sizes[sizes >= n].sum()
        assert r["truncated_tokens"] == np.minimum(sizes, n).sum()
    table = token_counts.length_histogram(odd)
    cut = {r["limit"]: (r["docs_over"], r["tokens"]) for r in token_counts.truncated_totals(table, [5, 500]).collect()}
    assert cut == {n: ((sizes > n).sum(), np.minimum(sizes, n).sum()) for n in (5, 500)}
    half = token_counts.length_quantiles(table, [0.5]).first()["length"]
    assert half == np.sort(sizes)[-(-len(sizes) // 2) - 1]
    assert token_counts.length_histogram(odd.limit(0)).count() == 0


def brute_statistics(text):
    words = WORD.findall(text)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        again += bool(WORD.search(line)) and line in seen
        seen.add(line)
    triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts, covered = Counter(triples), set()
    for k, t in enumerate(triples):
        if counts[t] > 1:
            covered |= {k, k + 1, k + 2}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered))


def test_quality_statistics_and_verdicts(documents, odd):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = quality_rules.quality_rules(documents, least=50).collect()
    for r in rows:
        assert tuple(r[c] for c in quality_rules.COUNTS) == brute_statistics(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
    clean = [r for r in rows if not r["base_failed"] and r["n_symbols"] < 0.05 * r["n_words"]]
    noisy = [r for r in rows if r["n_symbols"] > 0.5 * r["n_words"]]
    assert all(r["kept"] for r in clean) and not any(r["kept"] for r in noisy)
    assert quality_rules.quality_rules(odd).count() == odd.count()
    assert quality_rules.drop_outliers(odd).columns == odd.columns
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


@pytest.mark.parametrize("width", [3, 10])
def test_repeated_lines_are_outliers_of_a_clean_group(spark, width):
    random = np.random.default_rng(8)

    def lines(words):
        words = words.split()
        return [" ".join(words[k : k + width]) for k in range(0, len(words), width)]

    clean = [(k, "\n".join(lines(text_of(100 + k, int(random.integers(60, 400)))))) for k in range(300)]
    # One line twice, which a short document may hold.
    clean.append((300, "\n".join((x := lines(text_of(500, 90))) + x[:1])))
    again = lines(text_of(501, width)) * (120 // width)
    rows = clean + [(301, "\n".join(again + lines(text_of(502, 180))))]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert not found[301]["base_failed"] and found[301]["n_repeat_words"] == 120
    assert [i for i, r in found.items() if not r["kept"]] == [301]


def test_estimate_of_a_group_holds_out_its_outliers():
    random = np.random.default_rng(3)
    mix = np.eye(6)
    mix[3, 0] = -0.9
    clean = random.normal(size=(900, 6)) * 0.2 @ mix.T
    clean[:, 4:] = 0  # constant, as symbols and repeats are
    bad = random.normal(size=(100, 6)) * 0.1 + [0, 3, 3, 0, 4, 0]
    x = np.vstack([clean, bad])
    pairs = quality_rules._pairs()
    products = np.stack([x[:, i] * x[:, j] for i, j in pairs], axis=1)
    mean, cov = quality_rules.minimum_covariance(
        np.ones(1000), x, products, np.array(quality_rules.TOLERANCES)
    )
    assert abs(mean - clean.mean(axis=0)).max() < 0.03
    plain = np.cov(clean[:, :4].T)
    assert abs(np.corrcoef(clean[:, :4].T) - cov[:4, :4] / np.sqrt(np.outer(*[np.diag(cov)[:4]] * 2))).max() < 0.05
    assert (np.diag(cov)[:4] / np.diag(plain) > 0.7).all() and (np.diag(cov)[:4] / np.diag(plain) < 1.5).all()
    assert np.diag(cov)[4:].tolist() == pytest.approx([t * t for t in quality_rules.TOLERANCES[4:]])
    distances = quality_rules._distances(x, mean, cov)
    assert distances[:900].max() < quality_rules.CUTOFF < distances[900:].min()


def test_combination_of_statistics_is_rejected_where_each_is_usual(spark):
    """Of a fixed vocabulary, long texts hold small shares of distinct words and short ones large."""
    random = np.random.default_rng(5)
    words = text_of(77, 80).split()
    sizes = np.exp(random.uniform(np.log(60), np.log(900), 400)).astype(int)
    rows = [(k, " ".join(random.choice(words, n)), "en", "a") for k, n in enumerate(sizes)]
    rows.append((400, " ".join(random.choice(words[:20], 70)), "en", "a"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert [i for i, r in found.items() if not r["kept"]] == [400]
    stats = quality_rules.statistics(df)
    x = np.array([list(r)[1:] for r in stats.select("doc_id", *quality_rules.transformed()).orderBy("doc_id").collect()])
    matrix = np.array(quality_rules.robust_estimates(stats).filter("level = 0").first()["white"]).reshape(6, 6)
    cov = np.linalg.inv(matrix.T @ matrix)
    mean = np.array(quality_rules.robust_estimates(stats).filter("level = 0").first()["mean"])
    diagonal = ((x - mean) ** 2 / np.diag(cov)).sum(axis=1)
    assert diagonal[400] < quality_rules.CUTOFF / 2 < quality_rules.CUTOFF < found[400]["distance"]


def test_language_on_held_out_documents(documents, odd):
    marked = language_id.held_out(documents)
    model = language_id.fit(marked.filter("not held_out"))
    rows = language_id.identify(documents, model).join(marked, "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.9
    found = language_id.identify(odd, model).collect()
    assert len(found) == odd.count()
    assert {r["lang_pred"] for r in found if r["doc_id"] in (4, 5, 6, 12)} == {"und"}
    nothing = language_id.fit(documents.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0


def test_language_fit_reads_texts_twice(spark, documents):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    language_id.fit(documents.mapInArrow(counted, documents.schema))
    assert seen.value == 2 * documents.count()
    # Each task leaves out what can't be among the lowest, so that a frequent language is not one task.
    plan = language_id._lowest(documents, language_id.FIT_ROWS // 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_equal_texts_have_equal_scores_wherever_they_stand():
    weights = np.random.default_rng(4).normal(size=sum(language_id.SIZES))
    machine = language_id.Machine("de", "en", weights, 0.1)
    model = language_id.Model(("germanic",), {"germanic": ("de", "en")}, (), {"germanic": (machine,)})
    texts = [t for k in range(40) for t in ("a", text_of(k), None, "", "né", "Some text.", text_of(99), "x1")]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    found = pa.Table.from_batches(language_id._predict(model)(iter([batch]))).to_pylist()
    scores = {}
    for text, row in zip(texts, found, strict=True):
        scores.setdefault(text, set()).add((row["lang_pred"], row["score"]))
    assert all(len(s) == 1 for s in scores.values()) and scores[None] == scores[""] == {("und", 0.0)}
    for text in scores:
        if text:
            folded = re.sub(rb"[^a-z\x80-\xff]", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
            margin, start = 0.1, 0
            for n, size in enumerate(language_id.SIZES, start=1):
                grams = [int.from_bytes(folded[k : k + n], "big") for k in range(len(folded) - n + 1)]
                if grams:
                    codes = np.array(grams, np.uint64)
                    places = (mix(codes) % np.uint64(size) if n > 1 else codes).astype(int)
                    margin += 30 * weights[start + places].mean()
                start += size
            ((lang, score),) = scores[text]
            assert lang == ("de" if margin > 0 else "en") and score == pytest.approx(1 / (1 + np.exp(-3 * abs(margin))))


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(2 * sizes[s] for s in full)
        level = rest / max(1, sum(weight[s] for s in open_))
        above = {s for s in open_ if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not above:
            return {s: 2 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= above


@pytest.mark.parametrize("shard_words", [1_000_000, 3_000])
def test_mixing(documents, odd, shard_words):
    for docs in (documents, odd):
        rows = mixing.mix_sources(docs, shard_words=shard_words).toPandas()
        rows["source"] = rows["source"].map(lambda s: s if isinstance(s, str) else None)
        sizes = {s: int(rows[rows["source"].map(lambda x: x == s)]["size"].sum()) for s in set(rows["source"])}
        assert (rows["taken"] <= 2 * rows["size"]).all() and len(rows) == docs.count()
        for s, target in brute_targets(sizes).items():
            own = rows[rows["source"].map(lambda x: x == s)]
            assert own["target"].iloc[0] == pytest.approx(target)
            shards = -(-sizes[s] // shard_words)
            assert abs(own["taken"].sum() - target) <= 32 * max(1, shards) + 32
        again = mixing.mix_sources(docs.repartition(5), shard_words=shard_words)
        first = mixing.mix_sources(docs, shard_words=shard_words)
        assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    taken = mixing.take(documents)
    words = taken.select(F.sum(F.regexp_count("text", F.lit(WORD.pattern)))).first()[0]
    assert words == mixing.mix_sources(documents).agg(F.sum("taken")).first()[0]
    assert mixing.take(odd).columns == odd.columns
    assert mixing.mix_sources(odd.limit(0)).count() == mixing.take(odd.limit(0)).count() == 0


def test_sainte_lague_gives_highest_quotients(spark):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 23.0, "e": 0.0}
    seats = 7
    quotients = sorted(((-v / (2 * k + 1), p) for p, v in votes.items() for k in range(seats)))[:seats]
    cells = spark.createDataFrame([(p, v, float(seats), 9) for p, v in votes.items()], "p string, votes double, seats_in_all double, most bigint")
    found = mixing.sainte_lague(cells, [], [F.col("p")]).collect()
    assert {r["p"]: r["seats"] for r in found} == {p: Counter(q[1] for q in quotients)[p] for p in votes}


def test_sainte_lague_with_ties_and_limits_per_group(spark):
    random = np.random.default_rng(4)
    cells, expected = [], {}
    for group in ("x", "y", None):
        votes = [float(v) for v in random.integers(0, 6, 40) * 3]
        most = [int(m) for m in random.integers(2, 5, 40)]
        seats = {"x": 30, "y": 77, None: 0}[group]
        quotients = sorted((-v / (2 * k + 1), p) for p, v in enumerate(votes) for k in range(seats + 1) if v)
        given = Counter()
        for _, p in quotients:
            if sum(given.values()) < seats and given[p] < most[p]:
                given[p] += 1
        cells += [(group, p, votes[p], float(seats), most[p]) for p in range(40)]
        expected |= {(group, p): given[p] for p in range(40)}
    df = spark.createDataFrame(cells, "g string, p int, votes double, seats_in_all double, most bigint")
    found = mixing.sainte_lague(df.repartition(7), ["g"], [F.col("p")])
    assert {(r["g"], r["p"]): r["seats"] for r in found.collect()} == expected
    assert mixing.sainte_lague(df.limit(0), ["g"], [F.col("p")]).count() == 0
    assert mixing.sainte_lague(df.limit(0), [], [F.col("p")]).count() == 0


def test_url_rules_and_verdicts(spark):
    rows = [
        (1, "HTTP://WWW.Example.COM/en/x?q"), (2, "http://a.example.com/en/"), (3, "https://b.com"),
        (4, "http://x.net/es/1#t"), (5, "http://ynet/es/1"), (6, None), (7, "no scheme"), (8, ""),
        (9, "http://cheap-pills.example.org/en/450"), (10, "http://library.example.org/en/9"), (10, None),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit(1))
    weights = url_filter.train(url_filter.labelled_table(spark))
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages, weights).collect() if r["page_id"] != 10 or r["host"]}
    assert [found[k]["rule"] for k in range(1, 9)] == [
        "www.example.com/en/", "example.com/en/", None, "net/es/", None, None, None, None,
    ]
    assert (found[1]["host"], found[1]["path"]) == ("www.example.com", "/en/x")
    assert (found[6]["host"], found[7]["path"], found[3]["path"]) == ("", "", "")
    assert found[9]["verdict"] == "block" and found[10]["verdict"] == "allow"
    assert url_filter.judge_urls(pages.limit(0), weights).count() == 0
    with pytest.raises(ValueError):
        url_filter.train(url_filter.labelled_table(spark), most=3)


def test_hilbert_keys_are_a_walk():
    for axes, bits in ((2, 4), (3, 3)):
        grid = np.indices((1 << bits,) * axes).reshape(axes, -1).T
        keys = neighbours.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_neighbours_equal_brute_force(spark):
    random = np.random.default_rng(3)
    vectors = random.normal(size=(600, 16)).astype(np.float32)
    vectors[100:160] = vectors[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    bad = [(1001, None, 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [None] + [1.0] * 15, 1),
           (None, vectors[0].tolist(), 1), (1005, [1.0, 2.0], 1), (0, vectors[0].tolist(), 1)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, score int")
    found = neighbours.nearest(df, block=64).toPandas()
    x, hits = vectors.astype(float), 0
    for q, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        scores = x @ x[q]
        best = [i for i in np.lexsort((np.arange(600), -scores.round(12))) if i != q][:20]
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own["score"], scores[own["vec_id"]])
        hits += len(set(best) & set(own["vec_id"]))
    assert found["query_id"].nunique() == 30 and hits / 600 >= 0.9
    few = neighbours.nearest(df.filter("vec_id in (0, 20, 21)")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in few) == [(0, 1), (0, 2), (20, 1), (20, 2)]
    assert neighbours.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("gathered", [1 << 22, 600])
def test_nearest_of_equals_brute_force(monkeypatch, gathered):
    monkeypatch.setattr(neighbours, "_VECTORS", 64)
    monkeypatch.setattr(neighbours, "_GATHERED", gathered)
    random = np.random.default_rng(8)
    # Whole numbers, so that there are ties; and very short and long vectors.
    for scale in (np.ones((500, 1)), 2.0 ** random.integers(-20, 21, size=(500, 1))):
        vectors, queries = random.integers(-3, 4, size=(500, 6)) * scale, random.integers(1, 4, size=(30, 6)) * 1.0
        vectors[~vectors.any(axis=1)] = 1.0
        ids = random.permutation(500)
        for most in (500, 10, 0):
            rough, longest = neighbours._rough(vectors)
            found = neighbours._nearest_of(queries, vectors[:most], rough[:most], longest, ids[:most], 21)
            scores = np.einsum("ik,jk->ijk", queries, vectors[:most]).sum(axis=2)
            best = [np.lexsort((ids[:most], -s))[:21] for s in scores]
            assert found[0].tolist() == [q for q, b in enumerate(best) for _ in b]
            assert found[1].tolist() == [ids[j] for b in best for j in b]
            assert np.allclose(found[2], [scores[q, j] for q, b in enumerate(best) for j in b], rtol=1e-12)


def test_vectors_that_hardly_differ_are_not_gathered(monkeypatch):
    """32-bit floats can't tell these apart, so all of them may be near."""
    random = np.random.default_rng(10)
    vectors = np.full((3_000, 16), 0.25) + random.normal(size=(3_000, 16)) * 1e-9
    gathered = []
    monkeypatch.setattr(neighbours.np, "einsum", lambda how, a, b, f=np.einsum: gathered.append(a.size) or f(how, a, b))
    monkeypatch.setattr(neighbours, "_GATHERED", 10_000)
    found = neighbours._nearest_of(vectors[:40], vectors, *neighbours._rough(vectors), np.arange(3_000), 21)
    assert max(gathered, default=0) <= 10_000
    scores = vectors[:40] @ vectors.T
    for q in range(40):
        assert found[1][found[0] == q].tolist() == np.lexsort((np.arange(3_000), -scores[q]))[:21].tolist()


def test_queries_meet_strips_of_blocks(spark):
    random, radius = np.random.default_rng(9), 12
    vectors = random.normal(size=(1_000, 8))
    blocks = [random.permutation(1_000) // 10 for _ in range(2)]
    rows = [(c, int(blocks[c][i]), i, i % 20 == 0, vectors[i].tolist()) for c in range(2) for i in range(1_000)]
    placed = spark.createDataFrame(rows, "curve int, block int, rep bigint, asked boolean, embedding array<double>")
    strips = neighbours._strips(placed, radius, radius // 2)
    copies = [r["count"] for r in strips.filter("ask").groupBy("rep", "curve").count().collect()]
    assert len(copies) == 100 and max(copies) <= 6 < 2 * radius + 1
    lists = strips.repartition(3, "curve", "strip").sortWithinPartitions("curve", "strip", "ask", "block")
    found = neighbours._merged(lists.mapInArrow(neighbours._search(5, radius), neighbours._LISTS), 5).collect()
    for q in range(0, 1_000, 20):
        near = np.flatnonzero((abs(blocks[0] - blocks[0][q]) <= radius) | (abs(blocks[1] - blocks[1][q]) <= radius))
        best = near[np.argsort(-(vectors[near] @ vectors[q]))[:5]]
        assert {r["rep"] for r in found if r["query"] == q} == set(best.tolist())


def test_grades_on_held_out_documents(spark, odd):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    ratings = quality_classifier.grades(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality_classifier.train(documents, ratings.filter(~own))
    assert (np.diff(model.thresholds) > 0).all()
    rated = quality_classifier.classify(documents, model, 2).join(ratings.filter(own), "doc_id").collect()
    kept = {g: np.mean([r["kept"] for r in rated if r["grade"] == g]) for g in (0, 1, 2)}
    # A third of the toxic labels are on documents without a toxic word.
    assert kept[2] > 0.97 and kept[0] < 0.05 and kept[1] < 0.5
    assert quality_classifier.classify(odd, model, 2).count() == odd.count()
    assert quality_classifier.classify(odd.limit(0), model, 2).count() == 0
    empty = quality_classifier.train(odd, ratings.limit(0))
    assert quality_classifier.classify(odd, empty, 2).count() == odd.count()


def test_suffix_dedup_of_texts_that_hold_the_byte_between_pieces(spark):
    random = np.random.default_rng(8)
    stock = ["".join(random.choice(list("ab\0"), 40)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [stock[random.integers(6)] for _ in range(random.integers(1, 5))]
        rows.append((i, "\0" * int(random.integers(0, 3)) + "".join(parts) + "\0" * int(random.integers(0, 60))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    expected = brute_removed(rows, 50)
    found = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.suffix_dedup(df, 50, gram=20).collect()}
    assert found == {i: tuple(x[1:3]) for i, x in expected.items()}


def test_quality_classifier_with_a_column_of_grades(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = documents.selectExpr("doc_id", "text", "'x' AS grade", "1 AS places")
    model = quality_classifier.train(odd, quality_classifier.grades(labels))
    assert quality_classifier.classify(odd, model, 2).count() == odd.count()

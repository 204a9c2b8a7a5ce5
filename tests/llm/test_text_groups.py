"""Spelling groups, lexical search and SimHash groups against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from seektrail.llm import lexical_search, simhash_groups, spelling_groups

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id bigint, text string, id int, n int, word string, form string, key int, item_id string,"
    " score string, rank int, terms string, fingerprint int, component string, free int, near int"
)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 7, "w", "f", 7, "i", "s", 7, "t", 7, "c", 7, 7) for r in rows], SCHEMA)


def random_text(seed, words=60, letters="abcdeé", vocabulary=200, least=1, most=12):
    random = np.random.default_rng(seed)
    known = ["".join(random.choice(list(letters), random.integers(least, most))) for _ in range(vocabulary)]
    return " ".join(random.choice(known, words))


@pytest.fixture(scope="module")
def rows():
    long = random_text(5, 6000)
    return [
        *[(k, random_text(k % 7, 80 + k)) for k in range(40)],
        *[(100 + k, random_text(1, 150) + " Ä¿ tail" * (k % 3)) for k in range(12)],
        (3, random_text(9)), (3, random_text(9)), (None, random_text(9)), (None, None), (60, None),
        (61, ""), (62, " \t\n"), (63, long), (64, long[:-4]), (65, "ONE two"), (66, "one TWO\n"), (67, "!!! ... ???"),
        (68, "x\x00y \x00 abcdeeab\x00abcdeeab"), (69, "zq" * 5000 + " x " + "zq" * 5000),
        (70, "zq" * 5000 + "z"), (71, "zq" * 5000 + "z"), (72, "seven letters÷wordsÀÿ seven"),
    ]


@pytest.fixture(scope="module")
def odd(spark, rows):
    return frame(spark, rows).repartition(5)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def plain_groups(rows):
    words = plain_words(rows)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found_groups(df):
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    found = [tuple(r[c] for c in columns) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("share", [3, 200, spelling_groups.COMMON])
def test_spelling_groups_are_those_of_brute_force(spark, odd, rows, share):
    assert found_groups(spelling_groups.spelling_groups(odd, common_share=share)) == plain_groups(rows)


def test_spelling_groups_of_chains_ties_and_many_letters(spark):
    texts = {"abcdefg": 2, "abcdefgh": 30, "abcdefghi": 400, "xbcdefghi": 400, "àbcdefg": 2, "abcdefgé": 2}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(texts.items())]
    assert found_groups(spelling_groups.spelling_groups(frame(spark, rows))) == plain_groups(rows)
    random = np.random.default_rng(2)
    stems = ["".join(random.choice(list("abcd"), 8)) for _ in range(60)]
    words = [s[:k] + c + s[k + d :] for s in stems for k in range(9) for c in ("a", "é", "") for d in (0, 1)]
    rows = [(k, " ".join([w] * int(random.choice([2, 3, 40])))) for k, w in enumerate(words)]
    assert found_groups(spelling_groups.spelling_groups(frame(spark, rows))) == plain_groups(rows)


def test_spelling_groups_of_the_table(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found_groups(spelling_groups.spelling_groups(documents)) == plain_groups(rows)


def test_affected_bound_counts_what_one_edit_touches():
    assert spelling_groups.affected_bound([(0, 3), (4, 8)]) == 1
    assert spelling_groups.affected_bound([(0, 4), (4, 8), (3, 5)]) == 3


def plain_search(rows, items, best=50):
    def terms(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)

    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    count, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(terms(text))
    out = []
    for item, found in wanted.items():
        scores = []
        for i, c, n in docs:
            m = 100 - 50 + (50 * n * count) // total
            score = sum(
                math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in found
                if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i, score))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, i, s) for k, (_, _, i, s) in enumerate(scores[:best])]
    return Counter(out)


def found_search(df):
    return Counter(tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in df.collect())


def item_rows():
    return [
        (1, random_text(1, 20)), (2, random_text(2, 5) + " Ä¿"), (2, "tail tail ONE"), (None, "Two, one-two"), (4, None),
        (5, ""), (6, "!?"), (7, "unknown"), (8, random_text(1, 20)), (9, "y x"),
    ]


@pytest.mark.parametrize("most", [lexical_search.AUTOMATON_BYTES, 60, 1])
def test_search_is_that_of_brute_force(spark, odd, rows, most):
    items = spark.createDataFrame([(*r, "t", 7) for r in item_rows()], "item_id bigint, text string, terms string, block int")
    expected = plain_search(rows, item_rows(), 9)
    assert found_search(lexical_search.search(odd, items, best=9, most=most)) == expected


def test_search_of_the_table(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows, wanted = documents.select("doc_id", "text").collect(), items.select("item_id", "text").collect()
    assert found_search(lexical_search.search(documents, items)) == plain_search(rows, wanted)


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [words[k : k + 3] for k in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, prints, distance=2):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    array = np.array(values, np.uint64)
    for k, v in enumerate(values):
        for x in array[k + 1 :][np.bitwise_count(array[k + 1 :] ^ array[k]) <= distance].tolist():
            root[find(x)] = find(v)
    least = {}
    for (i, _), v in zip(rows, prints):
        if i is not None:
            least[find(v)] = min(i, least.get(find(v), i))
    return Counter((i, f"{v:016x}", least.get(find(v))) for (i, _), v in zip(rows, prints))


def found_prints(df):
    return Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect())


@pytest.mark.parametrize("most", [simhash_groups.GROUP, 1])
def test_simhash_groups_are_those_of_brute_force(spark, odd, rows, most):
    prints = [plain_print(t) for _, t in rows]
    assert found_prints(simhash_groups.simhash_groups(odd, most=most)) == plain_components(rows, prints)


def test_simhash_groups_of_the_table(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    prints = [plain_print(t) for _, t in rows]
    assert found_prints(simhash_groups.simhash_groups(documents)) == plain_components(rows, prints)


@pytest.mark.parametrize("most", [simhash_groups.GROUP, 30, 2])
def test_links_of_dense_fingerprints(spark, most):
    random = np.random.default_rng(4)
    base = random.integers(0, 2**63, 12, np.uint64)
    values = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(80):
            flips = random.choice(64, random.integers(1, 6), replace=False)
            values.add(b ^ sum(1 << int(f) for f in flips))
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(v,) for v in signed], "id bigint")
    found = simhash_groups.links(prints, most=most).collect()
    from seektrail.llm.components import components

    reached = {r["id"]: r["component"] for r in components(spark.createDataFrame(found, "a bigint, b bigint")).collect()}
    rows = [(v, None) for v in signed]
    expected = plain_components(rows, [v % 2**64 for v in signed])
    smallest = defaultdict(list)
    for v in signed:
        smallest[reached.get(v, v)].append(v)
    got = Counter((v, f"{v % 2**64:016x}", min(m)) for m in smallest.values() for v in m)
    assert got == expected


def test_empty_tables(spark):
    empty = frame(spark, [])
    items = spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert spelling_groups.spelling_groups(empty).collect() == []
    assert simhash_groups.simhash_groups(empty).collect() == []
    assert lexical_search.search(empty, one).collect() == []
    assert lexical_search.search(frame(spark, [(1, "one")]), items).collect() == []

import pytest

from seektrail.operators import privacy


def test_pseudonyms_still_join(spark):
    tables = {
        "users": spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "id bigint, name string"),
        "events": spark.createDataFrame([(1,), (1,), (3,), (None,)], "user int"),
        "other": spark.createDataFrame([(1,)], "n int"),
    }
    hidden = privacy.pseudonymize(tables, {"users": ["id"], "events": ["user"]}, "pepper")

    def joined(t):
        return t["users"].join(t["events"], t["users"]["id"] == t["events"]["user"]).count()

    assert joined(hidden) == joined(tables) == 2
    ids = [r["id"] for r in hidden["users"].collect()]
    assert ids[2] is None and all(len(i) == 64 for i in ids[:2])
    assert hidden["other"].collect() == tables["other"].collect()
    salted = privacy.pseudonymize(tables, {"users": ["id"]}, "salt")["users"].collect()
    assert salted[0]["id"] != ids[0]
    with pytest.raises(ValueError):
        privacy.pseudonymize(tables, {"users": ["id"]}, "")


@pytest.fixture(scope="module")
def texts(spark):
    long_text = "x" * 50_000 + " write to end@mail.example.org"
    rows = [
        (1, "nothing here - at. all @ once"),
        (2, "mail ann@example.com or bob.b@example.co.uk"),
        (3, "from 10.0.0.1, call 010-1234-5678 or 02-123"),
        (4, long_text),
        (5, None),
    ]
    return spark.createDataFrame(rows, "id int, text string")


def test_scan_counts_rows_and_hits(texts):
    rows = privacy.pii_scan(texts, "text").collect()
    assert {r["pattern"]: (r["rows"], r["hits"]) for r in rows} == {
        "email": (2, 3),
        "ip": (1, 1),
        "phone": (1, 1),
    }
    assert [r["hits"] for r in privacy.pii_scan(texts.limit(0), "text").collect()] == [0, 0, 0]


def test_mask_leaves_nothing_to_find(texts):
    masked = privacy.pii_mask(texts, "text")
    found = {r["id"]: r["text"] for r in masked.collect()}
    assert found[1] == "nothing here - at. all @ once"
    assert found[2] == "mail [email] or [email]"
    assert found[3] == "from [ip], call [phone] or 02-123"
    assert found[4].endswith("x write to [email]")
    assert found[5] is None
    assert {r["hits"] for r in privacy.pii_scan(masked, "text").collect()} == {0}


def test_every_match_contains_the_text_looked_for_first(spark):
    for pattern in privacy.PATTERNS.values():
        if pattern.contains is not None:
            assert pattern.contains in pattern.regex


def test_no_limits_and_no_silent_gates(spark):
    long_name = "a" * 100
    rows = [(f"to {long_name}@example.org now",), ("at a@b.xn--vermgensberatung-pwb",), ("ID 9001011234567",)]
    df = spark.createDataFrame(rows, "text string")
    assert [r[0] for r in privacy.pii_mask(df, "text").collect()][:2] == ["to [email] now", "at [email]"]
    own = {"id": privacy.Pattern(None, "[0-9]{6}-?[0-9]{7}")}
    assert privacy.pii_scan(df, "text", own).first()["hits"] == 1
    with pytest.raises(ValueError, match="customers"):
        privacy.pseudonymize({"customer": df}, {"customers": ["text"]}, "salt")
    report = privacy.pii_report({"a": df, "b": df.withColumn("n", df["text"])}).collect()
    assert {(r["table"], r["column"], r["hits"]) for r in report if r["pattern"] == "email"} == {
        ("a", "text", 2), ("b", "text", 2), ("b", "n", 2),
    }

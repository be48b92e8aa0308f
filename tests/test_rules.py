"""Rule filter: one case per rule, and the order-dependent rule against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from voxtide.functions import vocab
from voxtide.functions.text import fuzzy_hash, utrim, word_count
from voxtide.operators import language, rules, skew

CASES = [
    ("lol", "en", "min_text_length"),
    ("Je pense que cette technologie est très intéressante", "fr", "language"),
    ("see https://a.example https://b.example https://c.example https://d.example", "en", "url_density"),
    ("great stuff #a #b #c #d #e #f", "en", "hashtag_density"),
    ("Buy now and get a free tool today", "en", "keyword_blocklist"),
    ("AI tools changed the way I work every day", "en", None),
    ("AI tools changed the way I work every day!", "en", "near_duplicate"),
    ("AI tools changed the way I work every day", "en", None),
    ("an empty hint is not a missing hint", "", "language"),
    ("without a hint the detected language decides", None, None),
    ("ohne hinweis entscheidet die erkannte sprache", None, "language"),
    ("1234 5678 9012 3456 no letters known: ☃☃☃"[:19], None, None),
]


@pytest.fixture(scope="module")
def detector(spark):
    rows = [("with the hint of the language that decides without it", "en"), ("die sprache entscheidet ohne den hinweis der erkannt ist", "de")]
    return language.language_profile(spark.createDataFrame(rows, "text string, lang string"), ["de", "en"])


def test_one_case_per_rule(spark, detector):
    df = spark.createDataFrame([(i, t, l) for i, (t, l, _) in enumerate(CASES)], "ingest_seq long, text string, lang string")
    got = {r["ingest_seq"]: r["reason"] for r in rules.rejection_reasons(df, detector).collect()}
    assert got == {i: reason for i, (_, _, reason) in enumerate(CASES)}
    kept = [r["ingest_seq"] for r in rules.rule_filter(df, detector).collect()]
    assert sorted(kept) == [i for i, r in got.items() if r is None]


def test_empty_blocklist_means_default(spark):
    df = spark.createDataFrame([("Promo code inside",)], "text string")
    assert df.select(rules.blocklisted("text", [])).first()[0] is True
    assert df.select(rules.blocklisted("text", ["other"])).first()[0] is False


def sequential(rows, scope):
    """The rule as a loop over arriving rows."""
    seen, out = {}, {}
    for seq, text, group in sorted(rows):
        if len(text.strip()) < vocab.MIN_TEXT_LENGTH:
            out[seq] = "min_text_length"
            continue
        key = (group if scope else None, " ".join(re.sub(r"[^\w\s]", "", text.lower()).split()))
        if key in seen and seen[key] != text:
            out[seq] = "near_duplicate"
        else:
            seen[key] = text
            out[seq] = None
    return out


@pytest.mark.parametrize("scope", [None, "grp"])
def test_near_duplicates_match_a_loop(spark, detector, scope):
    rng = random.Random(5)
    stems = ["the same words again and again", "another post about tools today", "short"]
    rows = [(i, rng.choice(stems) + rng.choice(["", "!", "?", " ", "."]), rng.choice("ab")) for i in range(600)]
    df = spark.createDataFrame(rows, "ingest_seq long, text string, grp string").withColumn("lang", F.lit("en"))
    got = {r["ingest_seq"]: r["reason"] for r in rules.rejection_reasons(df, detector, session=scope).collect()}
    assert got == sequential(rows, scope)


def test_near_duplicates_with_more_keys_than_are_broadcast(spark, detector, monkeypatch):
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    monkeypatch.setattr(skew.heaviest, "__defaults__", (3,))
    rng = random.Random(6)
    rows = [(i, f"some longer words number {min(int(rng.expovariate(0.2)), 30)}" + rng.choice(["", "!"]), "a") for i in range(500)]
    df = spark.createDataFrame(rows, "ingest_seq long, text string, grp string").withColumn("lang", F.lit("en"))
    got = {r["ingest_seq"]: r["reason"] for r in rules.rejection_reasons(df, detector).collect()}
    assert got == sequential(rows, None)


def test_text_helpers_follow_python(spark):
    texts = ["\n a ", " x y z　", "", "a\x1fb", "Hi!! There,  you", "Ünï_cödé #tag"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", utrim("t").alias("trim"), word_count("t").alias("n"), fuzzy_hash("t").alias("h")).collect():
        import hashlib
        plain = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", r["t"].lower())).strip()
        assert (r["trim"], r["n"]) == (r["t"].strip(), len(r["t"].split()))
        assert r["h"] == hashlib.md5(plain.encode()).hexdigest()

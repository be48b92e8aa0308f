"""Cleaning chain, statuses and the CSV chain."""

import pytest
from pyspark.sql import functions as F

from voxtide.functions import vocab
from voxtide.operators import cleaning
from voxtide.schema import CLEAN_STATUSES

LONG = "these tools have made my daily work so much faster and easier than ever before"


def clean(spark, rows):
    df = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate(rows)], "ingest_seq long, text string, author string")
    return {r["ingest_seq"]: (r["cleaned_text"], r["clean_status"]) for r in cleaning.clean_rows(df).collect()}


def test_chain(spark):
    text = "<p>I CAN'T believe <b>15</b> AI tools 😀 replaced https://x.example my # workflow, women&amp;children said so, twice!</p>"
    out = clean(spark, [(text, "me")])[0]
    assert out[1] == "cleaned"
    words = out[0].split(" ")
    assert "cannot" in words and "grinning_face" in words and "#workflow" in words and "woman" in words and "child" in words
    assert "15" not in out[0] and "https" not in out[0] and "<" not in out[0] and out[0] == out[0].lower()
    assert "," in words and "!" in words and "twice" in words


def test_statuses(spark):
    got = clean(spark, [
        ("too few words", "me"), ("I am a bot. " + LONG, "me"), (LONG, "newsbot.example"), (LONG, "abbott"),
        ("  " + LONG.upper() + " ", "other"), (LONG + " indeed", "x-AutoMod"),
    ])
    # rows 2, 3, 4 share a text: the first keeps its own status
    assert [got[i][1] for i in range(6)] == ["too_short", "bot", "bot", "duplicate", "duplicate", "bot"]
    assert all(t is None for t, s in got.values() if s != "cleaned")


def test_summary_shows_zeros(spark):
    df = spark.createDataFrame([("bot",), ("bot",)], "clean_status string")
    got = {r["clean_status"]: r["n"] for r in cleaning.clean_summary(df, CLEAN_STATUSES).collect()}
    assert got == {"cleaned": 0, "too_short": 0, "bot": 2, "duplicate": 0}


@pytest.mark.parametrize("word, lemma", [
    ("tools", "tool"), ("cities", "city"), ("boxes", "box"), ("glass", "glass"), ("this", "this"), ("women", "woman"),
    ("#tags", "#tags"), ("bus", "bus"), ("news", "news"), ("run", "run"), ("churches", "church"),
])
def test_lemma(spark, word, lemma):
    assert spark.createDataFrame([(word,)], "t string").select(cleaning.lemma(F.col("t"))).first()[0] == lemma


def test_csv_chain_and_stats(spark):
    rows = [
        ("one two three four five six seven eight nine ten",),
        ("only a few words",),
        ("I am a bot, and this action was performed automatically. " + LONG,),
        (LONG + " <img src=x> ![p](http://y.example/z.png) see www.a.example",),
        ("one two three four five six seven eight nine http://gone.example",),
    ]
    out = cleaning.csv_chain(spark.createDataFrame(rows, "text string"))
    texts = sorted(r["text"] for r in out.collect())
    assert texts == sorted([rows[0][0], LONG + " see"])
    stats = cleaning.corpus_stats(out).first()
    words = [w for t in texts for w in t.lower().split()]
    assert (stats["records"], stats["words"], stats["unique_words"]) == (2, len(words), len(set(words)))
    assert stats["words_per_record"] == round(len(words) / 2, 2)
    assert cleaning.corpus_stats(out.where("false")).count() == 0


def test_bot_phrases_ignore_case(spark):
    df = spark.createDataFrame([(p.upper(),) for p in vocab.BOT_PHRASES] + [("robots are fine",)], "t string")
    assert [r[0] for r in df.select(cleaning.bot_phrase("t")).collect()] == [True] * len(vocab.BOT_PHRASES) + [False]


def test_entities_and_emoji(spark):
    cases = {
        "it&#8217;s caf&eacute; &#x1F970;": "it\u2019s caf\u00e9 \U0001F970", "a &amp;lt; b &lt; c": "a &lt; b < c", "&#38;gt; &bogus; &#0; &#xD800;": "&gt; &bogus; &#0; &#xD800;",
        "&nbsp;x&copy;": " x\u00a9", "&": "&", "": "", None: None, "<b>AT&amp;T</b>": " AT&T ",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r["t"]: r["o"] for r in df.select("t", cleaning.strip_html("t").alias("o")).collect()}
    assert got == cases
    named = {r["t"]: r["o"] for r in spark.createDataFrame([("ok \U0001F970\U0001F973!",), ("\U0001F600",), ("none",), (None,)], "t string").select(
        "t", cleaning.demojize("t").alias("o")).collect()}
    assert named == {"ok \U0001F970\U0001F973!": "ok  smiling_face_with_smiling_eyes_and_three_hearts  face_with_party_horn_and_party_hat !",
                     "\U0001F600": " grinning_face ", "none": "none", None: None}


def test_tags_end_outside_of_quotes(spark):
    cases = {
        '<a title="x > y">link</a>': " link ", "<img alt='a > b' src=i.png>z": " z", "<p>it's</p> 1 < 2 > 0": " it's  1 < 2 > 0", "a <b c=\"d>e": "a  e",
        '<a x = "1>2" y=3 z>t': " t", "&lbrace;&Tab;&NotEqualTilde;": "{\t≂̸", "<br/><!-- > -->x": "  x", '<a x==">">y': ' ">y',
        "<a " + "b=c " * 20_000 + "d='>'>e": " '>e", "<a " + "=" * 50_000: "<a " + "=" * 50_000,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["o"] for r in df.select("t", cleaning.strip_html("t").alias("o")).collect()} == cases


@pytest.mark.parametrize("emoji, name", [
    ("\U0001F1E9\U0001F1EA", "flag_de"), ("⏰", "alarm_clock"), ("\U0001F469‍\U0001F4BB", "woman_technologist"), ("\U0001F44D\U0001F3FD", "thumbs_up_medium_skin_tone"),
    ("1️⃣", "keycap_1"), ("#⃣", "keycap_#"), ("❤️", "red_heart"), ("\U0001F469\U0001F3FE‍\U0001F680", "woman_astronaut_medium-dark_skin_tone"),
    ("\U0001F3F4\U000E0067\U000E0062\U000E0073\U000E0063\U000E0074\U000E007F", "flag_gbsct"), ("\U0001F9D1‍⚕️", "health_worker"),
    ("\U0001F468‍\U0001F469‍\U0001F467", "man_woman_girl"), ("\U0001F3FF", "emoji_modifier_fitzpatrick_type-6"), ("™", "trade_mark_sign"),
])
def test_emoji_sequences_have_one_name(spark, emoji, name):
    rows = [(f"a{emoji}b",), (emoji * 2,), (f"x {emoji}",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(cleaning.demojize("t")).collect()]
    assert got == [f"a {name} b", f" {name}  {name} ", f"x  {name} "]


def test_what_is_no_emoji_stays(spark):
    rows = ["\U0001F1E9 a", "1 # *", "\U0001F1E6\U0001F1E9\U0001F1EA\U0001F1F8 \U0001F1E9\U0001F1EA", "‍", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(cleaning.demojize("t")).collect()]
    assert got == ["\U0001F1E9 a", "1 # *", " flag_ad  flag_es   flag_de ", "‍", ""]


def test_quick_patterns_find_the_same():
    """All signs, letters and keys at the start of what is found stand in the ranges looked at first."""
    import re

    near = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), cleaning._NEAR) + "]")
    signs = [chr(c) for low, high in [*vocab.EMOJI_RANGES, *vocab.EMOJI_SIGNS, (0x1F1E6, 0x1F1FF), (0x20E3, 0x20E3)] for c in range(low, high + 1)]
    assert all(near.match(c) for c in signs) and not near.search("aé1#字かж한")
    assert not any(p == cleaning.EMOJI for p in (cleaning.EMOJI_FAST, cleaning.EMOJI_HINT_FAST))


def test_runs_of_white_space_become_one_space(spark):
    import random

    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab  \n\t\xa0\u3000") for _ in range(rnd.randrange(12))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", cleaning.normalize_whitespace("t").alias("o")).collect()
    assert all(r.o == " ".join(texts[r.i].split()) for r in rows)

"""Sentiment, relevance and language."""

import pyarrow as pa
from pyspark.sql import types as T

from voxtide.functions import vocab
from voxtide.operators import language, relevance, sentiment, votes
from voxtide.operators.sentiment import lexicon_sentiment, lexicon_table


def scores(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "post_id long, text string")
    out = lexicon_sentiment(df, lexicon_table(spark), ["post_id"])
    return [r["sentiment_score"] for r in out.orderBy("post_id").collect()]


def test_three_sentences(spark):
    pos, neg, neu, empty = scores(spark, [
        "What a great garden, the roses are good this year.",
        "The train was late again and the coffee was awful.",
        "The library opens at nine on weekdays.", "",
    ])
    assert pos > 0.4 and neg < -0.2 and neu == 0.0 and empty == 0.0


def test_rows_with_one_key_stay_apart(spark):
    df = spark.createDataFrame([("a", "this is good"), ("a", "this is good"), ("a", None)], "post_id string, text string")
    rows = lexicon_sentiment(df, lexicon_table(spark), ["post_id"])
    one = round(1.9 / (1.9 ** 2 + 15) ** 0.5, 4)
    assert sorted(r["sentiment_score"] for r in rows.collect()) == [0.0, one, one]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    votes = relevance.candidate_scores(df, {"x": {"good": 5}, "y": {"bad": 3}}, ["post_id"], "text")
    assert sorted(r["votes"] for r in votes.collect()) == [[0, 0], [5, 0], [5, 0]]
    assert "Exchange" not in votes._jdf.queryExecution().executedPlan().toString()


def test_rules(spark):
    plain, very, not_good, loud, shout, but = scores(spark, [
        "this is good", "this is very good", "this is not good", "this is good!!!", "this is GOOD", "this is good but awful",
    ])
    assert very > plain > 0 > not_good
    assert loud > plain and shout > plain and but < 0
    assert plain == round(1.9 / (1.9 ** 2 + 15) ** 0.5, 4)


def test_summary(spark):
    rows = [("a", 0.5, "positive")] * 6 + [("a", -0.5, "negative")] * 4 + [("b", None, None)]
    df = spark.createDataFrame(rows, "platform string, sentiment_score double, sentiment_label string")
    s = sentiment.summarize(df).first()
    assert (s["total"], s["positive"], s["negative"], s["neutral"], s["avg_score"]) == (10, 6, 4, 0, 0.1)
    p = sentiment.percentages(sentiment.summarize(df)).first()
    assert (p["positive_pct"], p["negative_pct"], p["neutral_pct"]) == (60.0, 40.0, 0.0)
    nothing = sentiment.summarize(df.where("false")).first()
    assert (nothing["total"], nothing["avg_score"]) == (0, 0.0)


def test_candidates(spark):
    df = spark.createDataFrame([(1, "buy this limited offer"), (2, "zzz"), (3, "I love my tools")], "post_id long, text string")
    out = {r["post_id"]: r for r in relevance.relevance_labels(df, ["post_id"], "text").collect()}
    assert (out[1]["relevance_label"], out[3]["relevance_label"]) == ("spam", "relevant")
    assert abs(out[2]["relevance_score"] - 1 / 3) < 1e-12 and out[2]["relevance_label"] == "relevant"
    sums = relevance.candidate_scores(df, vocab.RELEVANCE_TERMS, ["post_id"], "text").collect()
    assert all(abs(sum(r["scores"]) - 1) < 1e-9 for r in sums)


def test_null_labels_stay(spark):
    df = spark.createDataFrame([(None,), ("relevant",), ("spam",)], "relevance_label string")
    assert relevance.relevant_only(df).count() == 2


def test_language(spark):
    train = spark.createDataFrame([("the cat and the dog and the house of the man", "en"), ("der hund und die katze und das haus der frau", "de")], "text string, lang string")
    profile = language.language_profile(train, ["de", "en"])
    df = spark.createDataFrame([(1, "the dog of the house", None), (2, "der hund und die frau", None), (3, "???", None), (4, "x", "en")], "post_id long, text string, lang string")
    got = {r["post_id"]: r["detected"] for r in language.with_detected(df, profile).collect()}
    assert got == {1: "en", 2: "de", 3: None, 4: None}


def test_joined_lexicon_scores_as_one_in_the_plan(spark):
    texts = ["GREAT roses, but the coffee was not very good!!", "awful awful awful", "", None, "nothing known here", "I don't love it, really?", "good " * 500]
    rows = [(1, t) for t in texts] * 2 + [(None, "good")]
    df = spark.createDataFrame(rows, "post_id long, text string")
    lexicon = lexicon_table(spark).unionByName(spark.createDataFrame([(None, 1.0), ("roses", None)], "term string, valence double"))
    # 500,000 terms besides, none of them in the texts
    many = lexicon.unionByName(spark.range(500_000).selectExpr("concat('w', id) as term", "1.0D as valence"))
    small, joined, large = (sorted((str(r[0]), r[1]) for r in d.collect()) for d in (
        lexicon_sentiment(df, lexicon, ["post_id"]), lexicon_sentiment(df, lexicon, ["post_id"], max_terms=0), lexicon_sentiment(df, many, ["post_id"])))
    assert small == joined == large and len(small) == len(rows) and len({x for _, x in small}) > 4
    empty = lexicon_sentiment(df, lexicon.limit(0), ["post_id"]).collect()
    assert len(empty) == len(rows) and {r["sentiment_score"] for r in empty} == {0.0}


def test_votes_from_a_table(spark):
    weights = vocab.RELEVANCE_TERMS
    table = spark.createDataFrame([(t, *[w.get(t, 0) for w in weights.values()]) for t in sorted({t for w in weights.values() for t in w})],
                                  ["term", *[f"v{i}" for i in range(len(weights))]])
    words = list(table.limit(5).toPandas()["term"])
    df = spark.createDataFrame([(1, " ".join(words)), (1, words[0] * 1 + " x " + words[0]), (2, ""), (3, None)], "post_id long, text string")
    a, b = (sorted(map(str, relevance.candidate_scores(df, w, ["post_id"], "text").collect())) for w in (weights, table))
    assert a == b and len(a) == 4


def test_a_block_asks_for_a_word_once(spark):
    """A word in every row comes to the join once per block of rows, and rows, places and
    values come back whole, also from blocks without a known word."""
    words = lambda i: ["the", "very", None, f"w{i % 7}", "the"] if i % 5 and i < 4000 else []
    rows = votes.numbered(spark.createDataFrame([(i, words(i)) for i in range(5000)] + [(-1, None)], "id long, words array<string>").coalesce(1))
    lexicon = spark.createDataFrame([("the", 1, 0.5), ("w3", 2, None), ("w999", 3, 1.5)], "term string, a long, b double")

    def places(block, row, places, found):
        hits = [[] for _ in range(block.num_rows)]
        starts = [0]
        for w in block["words"].to_pylist():
            starts.append(starts[-1] + len(w or []))
        for r, at, f in zip(row, places, found.to_pylist()):
            hits[r].append(f"{at - starts[r]} {f['a']} {f['b']}")
        return block.select(["id"]).append_column("hits", pa.array([" ".join(h) for h in hits], pa.string()))

    kind = T.StructType().add("id", "long").add("hits", "string")
    out = votes.looked_up(rows, "words", lexicon, ["a", "b"], kind, places)
    values = {"the": (1, 0.5), "w3": (2, None)}
    want = {i: " ".join(f"{k} {values[w][0]} {values[w][1]}" for k, w in enumerate(words(i)) if w in values) for i in range(5000)} | {-1: ""}
    assert {r.id: r.hits for r in out.collect()} == want
    none = votes.looked_up(rows, "words", lexicon.limit(0), ["a", "b"], kind, places)
    assert none.count() == 5001 and none.where("hits <> ''").count() == 0
    asked = votes.asked(rows, "words").groupBy("_word").count().where("_word = 'the'").first()
    assert asked["count"] <= 5001 / 2 ** votes.BLOCK_BITS + 1

"""Spellings, thresholds, hierarchy and annotation."""

import math

import pytest
from pyspark.sql import functions as F

from voxtide.functions import vocab
from voxtide.functions.vocab import SARCASM_HYPOTHESES
from voxtide.operators import labels, relevance, scoring, state
from voxtide.schema import POLARITY_LABELS, SUBJECTIVITY_LABELS


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", expr.alias("o")).orderBy("i").collect()]


def test_model_labels(spark):
    got = column(spark, [" Opinionated", "LABEL_0", "label_1", None], labels.normalize_model_label("v", SUBJECTIVITY_LABELS))
    assert got == ["opinionated", "neutral", "opinionated", None]
    with pytest.raises(Exception, match="unsupported model label"):
        column(spark, ["label_7"], labels.normalize_model_label("v", SUBJECTIVITY_LABELS))


def test_sarcasm_labels(spark):
    values = ["Sarcasm", "not_sarcastic", "non-sarcasm", *SARCASM_HYPOTHESES.values()]
    assert column(spark, values, labels.normalize_sarcasm_label("v")) == [
        "sarcastic", "non-sarcastic", "non-sarcastic", "sarcastic", "non-sarcastic"]
    with pytest.raises(Exception, match="unsupported sarcasm label"):
        column(spark, ["irony"], labels.normalize_sarcasm_label("v"))


def test_threshold_and_nan(spark):
    got = column(spark, [0.5, 0.49, math.nan], labels.apply_threshold("v", "opinionated", SUBJECTIVITY_LABELS, 0.5), "double")
    assert got == ["opinionated", "neutral", "neutral"]


def hierarchy(spark, rows, t1, t2, calls):
    df = spark.createDataFrame(rows, "post_id string, op double, pos double")
    stage1 = lambda d: d.withColumn("scores", labels.score_map(["opinionated", "neutral"], ["op", 1 - F.col("op")]))

    def stage2(d):
        calls.append(sorted(r["post_id"] for r in d.select("post_id").collect()))
        return d.withColumn("scores", labels.score_map(["positive", "negative"], ["pos", 1 - F.col("pos")]))

    return {r["post_id"]: r for r in labels.hierarchical_predict(df, stage1, stage2, t1, t2).collect()}


def test_stage_two_sees_opinionated_rows_only(spark):
    calls = []
    out = hierarchy(spark, [("a", 0.84, 0.28), ("b", 0.20, 0.9)], 0.5, 0.5, calls)
    assert calls == [["a"]]
    assert (out["a"]["stage1_label"], out["a"]["stage2_label"], out["a"]["final_label"]) == ("opinionated", "negative", "negative")
    assert abs(out["a"]["stage2_score"] - 0.72) < 1e-9
    assert (out["b"]["stage2_label"], out["b"]["stage2_score"], out["b"]["final_label"]) == (None, None, "neutral")
    assert abs(out["b"]["stage1_score"] - 0.80) < 1e-9


def test_saved_thresholds(spark):
    out = hierarchy(spark, [("a", 0.55, 0.9), ("b", 0.91, 0.75)], 0.6, 0.8, [])
    assert (out["a"]["final_label"], out["b"]["final_label"]) == ("neutral", "negative")


def test_polarity(spark):
    df = spark.createDataFrame([(1, {"positive": 0.4, "negative": 0.4, "neutral": 0.9}), (2, {"negative": 0.1}), (3, {"neutral": 1.0})],
                               "i int, v map<string,double>")
    assert [r[1] for r in df.select("i", labels.polarity_pos_neg("v")).orderBy("i").collect()] == ["positive", "negative", "positive"]


def test_candidates_and_merge(spark):
    rows = spark.createDataFrame([("p1", "text one", "", ""), ("p2", "text two", "", "neutral"), ("p3", " ", "", "")],
                                 "post_id string, text string, cleaned_text string, subjectivity_label string")
    targets = ["subjectivity_label", "subjectivity_score"]
    assert sorted(r["post_id"] for r in labels.annotation_candidates(rows, targets).collect()) == ["p1", "p2"]
    updates = spark.createDataFrame([("p1", "neutral", 0.1, 1), ("p1", "opinionated", 0.9, 2), ("zz", "x", 0.2, 3)],
                                    "post_id string, subjectivity_label string, s double, n int")
    updates = updates.withColumn("subjectivity_score", labels.format_score("s"))
    out = labels.merge_annotations(rows, updates, targets, order="n")
    assert out.columns == ["post_id", "text", "cleaned_text", "subjectivity_label", "subjectivity_score"]
    got = {r["post_id"]: (r["subjectivity_label"], r["subjectivity_score"]) for r in out.collect()}
    assert got == {"p1": ("opinionated", "0.900000"), "p2": ("neutral", ""), "p3": ("", "")}


def test_placeholders(spark):
    rows = spark.createDataFrame([("p1", "t", "", "x", "nan"), ("p2", "t", "", "x", "0.910000")],
                                 "post_id string, text string, cleaned_text string, l string, s string")
    assert [r["post_id"] for r in labels.annotation_candidates(rows, ["l", "s"]).collect()] == ["p1"]
    assert labels.annotation_candidates(rows, ["l", "s"], force=True).count() == 2


def test_score_format(spark):
    assert column(spark, [0.8754321, math.nan, None, math.inf], labels.format_score("v"), "double") == ["0.875432", "", "", ""]
    assert column(spark, ["0.5", "abc", "-inf"], labels.format_score("v")) == ["0.500000", "", ""]


@pytest.mark.parametrize("n", [0, 1, 2, 11, 40])
def test_p95(spark, n):
    values = [(i * 7) % 13 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    want = sorted(values)[int(round((n - 1) * 0.95))] if n else 0
    assert labels.p95_nearest_rank(df, "v").first()["p95"] == want


def test_p95_of_as_many_values_as_rows(spark):
    import random

    rng = random.Random(5)
    big = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(3000)] + [(1 << 62) + i for i in range(400)]
    tiny = [rng.gauss(0, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(3000)] + [1.7e308, -1.7e308]
    for values, kind in ((big, "long"), (tiny, "double"), ([5] * 100, "int"), ([7] * 95 + [9] * 5, "long")):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], f"v {kind}")
        for share in (0.0, 0.5, 0.95, 1.0):
            out = labels.p95_nearest_rank(df, "v", share)
            assert out.first()[0] == sorted(values)[round((len(values) - 1) * share)]
            assert out.dtypes == [("p95", {"long": "bigint"}.get(kind, kind))]
            assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    odd = spark.createDataFrame([(v,) for v in (math.nan, math.inf, 1.0, -math.inf, 2.0)], "v double")
    assert [str(labels.p95_nearest_rank(odd, "v", s).first()[0]) for s in (0, 0.25, 0.5, 0.75, 1)] == ["-inf", "1.0", "2.0", "inf", "nan"]


def test_stats(spark):
    df = spark.createDataFrame([("a" * n,) for n in range(1, 41)] + [("  ",)], "text string")
    s = labels.annotation_stats(df, batch_size=16, elapsed_seconds=2.0).first()
    assert (s["total_records"], s["total_batches"], s["max_characters_per_text"], s["p95_characters_per_text"]) == (40, 3, 40, 38)
    assert s["avg_characters_per_text"] == 20.5 and s["records_per_second"] == 20.0


def test_scorer_plugin(spark):
    def make_scorer():
        return lambda texts: [{"n": float(len(t))} for t in texts]

    df = spark.createDataFrame([(i, "x " * i) for i in range(1, 30)], "post_id long, text string")
    out = scoring.score_with(df, make_scorer, "text", ["post_id"], "len", batch_size=4)
    assert {r["post_id"]: r["scores"]["n"] for r in out.collect()} == {i: 2.0 * i for i in range(1, 30)}
    cut = scoring.score_with(df, make_scorer, "text", ["post_id"], "len", max_tokens=3)
    assert max(r["scores"]["n"] for r in cut.collect()) == 6.0


def test_state(spark):
    base = spark.createDataFrame([("a", "old", "bot", 1), ("b", "keep", "cleaned", 2)], "post_id string, cleaned_text string, clean_status string, likes int")
    updates = spark.createDataFrame([("a", None, "duplicate"), ("zz", "x", "bot")], "post_id string, cleaned_text string, clean_status string")
    out = {r["post_id"]: tuple(r)[1:] for r in state.apply_updates(base, updates, ["cleaned_text", "clean_status"]).collect()}
    assert out == {"a": (None, "duplicate", 1), "b": ("keep", "cleaned", 2)}
    assert state.pending_clean(state.reset_columns(base, "clean")).count() == 2
    with pytest.raises(ValueError):
        state.pending_classification(base, "mood")


def test_label_store_shuffles_no_text(spark):
    base = spark.createDataFrame([(f"p{i}", f"text {i} " * 20, "old", None if i % 2 else "bot", i) for i in range(300)],
                                 "post_id string, text string, cleaned_text string, clean_status string, likes int")
    steps = [
        spark.createDataFrame([(f"p{i}", None if i % 4 == 0 else f"new {i}", "cleaned") for i in range(0, 400, 2)], "post_id string, cleaned_text string, clean_status string"),
        spark.createDataFrame([("p4", "b", "x"), ("p4", "c", "a"), (None, "n", "n"), ("zz", "z", "z")], "post_id string, cleaned_text string, clean_status string"),
    ]
    likes = spark.createDataFrame([("p1", 7), ("p2", None)], "post_id string, likes int")
    store, want = state.open_store(base, buckets=4), base
    for updates in steps:
        store = state.put_labels(spark, store, updates, ["cleaned_text", "clean_status"])
        want = state.apply_updates(want, updates, ["cleaned_text", "clean_status"])
    store = state.put_labels(spark, store, likes, ["likes"])
    want = state.apply_updates(want, likes, ["likes"])
    off = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = state.read_store(spark, store)
        assert out.columns == base.columns
        assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") >= 2 and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", off)
    with pytest.raises(ValueError):
        state.put_labels(spark, store, likes.withColumn("clean_status", F.lit("x")), ["likes", "clean_status"])
    state.drop_store(spark, store)
    assert not spark.catalog.tableExists(store.posts)


def test_a_filter_on_a_score_reads_the_text_once(spark):
    """The filter goes below the projections with the whole expression of the score."""
    words = list(vocab.POLARITY_TERMS["positive"])[:3]
    df = spark.createDataFrame([("a", " ".join(words)), ("b", ""), ("c", None)], "post_id string, text string")
    scores = relevance.candidate_scores(df, vocab.POLARITY_TERMS, ["post_id"], "text")
    out = scores.withColumn("p", F.round(F.get("scores", F.lit(list(vocab.POLARITY_TERMS).index("positive"))), 6)).where("p > 0.5").select("post_id")
    assert [r["post_id"] for r in out.collect()] == ["a"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert len(scores.collect()) == 3

"""Dataset building, metrics, tuning, agreement and training."""

import random

import pytest
from pyspark.sql import functions as F

from voxtide.operators import agreement, dataset, metrics, training
from voxtide.plans import jobs
from voxtide.schema import FINAL_LABELS, SARCASM_LABELS, SUBJECTIVITY_LABELS

MANUAL = [
    ("p1", "text 1", "", "opinionated", "positive"), ("p2", "text 2", "", "opinionated", "negative"),
    ("p3", "text 3", "", "neutral", "neutral"), ("p4", "", "", "neutral", "neutral"),
    ("p5", "text 5", "", "", "positive"), ("p6", "text 6", "", "opinionated", ""),
    ("p7", "text 7", "", "opinionated", "neutral"), ("p8", " ", "clean 8", "opinionated", "positive"),
    ("p9", "text 9", "", "neutral", "positive"),
]


def manual(spark):
    df = spark.createDataFrame(MANUAL, "post_id string, text string, cleaned_text string, subjectivity_detection string, polarity_detection string")
    return dataset.load_manual_labels(df)


def test_stage_rows_and_anomalies(spark):
    df = manual(spark)
    assert dataset.subjectivity_rows(df).count() == 7
    pol = {r["post_id"]: (r["text"], r["label"]) for r in dataset.polarity_rows(df).collect()}
    assert pol == {"p1": ("text 1", 1), "p2": ("text 2", 0), "p8": ("clean 8", 1)}
    assert tuple(dataset.label_anomalies(df).first()) == (1, 1, 1, 1, 1)
    assert {r["post_id"] for r in dataset.final_label_rows(df).collect()} == {"p1", "p2", "p3", "p8"}


@pytest.mark.parametrize("ratio, seed", [(0.2, 42), (0.5, 7), (0.0, 1)])
def test_split_sizes(spark, ratio, seed):
    sizes = {0: 1, 1: 2, 2: 37, 3: 400}
    rows = [(f"{l}-{i}", l) for l, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "post_id string, label int")
    got = {r["label"]: r["n"] for r in dataset.stratified_split(df, ratio=ratio, seed=seed).where("split = 'validation'")
           .groupBy("label").agg(F.count("*").alias("n")).collect()}
    want = {}
    for l, n in sizes.items():
        if n > 1 and ratio > 0:
            want[l] = min(max(1, round(n * ratio)), n - 1)
    assert got == want


def test_shared_split(spark):
    rows = [(f"n{i}", "t", 0, "neutral") for i in range(2)] + [(f"q{i}", "t", 1, "negative") for i in range(2)] + [(f"r{i}", "t", 2, "positive") for i in range(2)]
    split = dataset.stratified_split(spark.createDataFrame(rows, "post_id string, text string, label int, label_name string"), ratio=0.5, seed=7)
    counts = {r["stage"]: (r["total"], r["train"], r["validation"]) for r in dataset.stage_counts(dataset.derive_stage_rows(split)).collect()}
    assert counts == {"final_label": (6, 3, 3), "subjectivity": (6, 3, 3), "polarity": (4, 2, 2)}


def plain_binary(gold, pred, pos):
    div = lambda a, b: a / b if b else 0.0
    tp = sum(g == pos and p == pos for g, p in zip(gold, pred))
    fp = sum(g != pos and p == pos for g, p in zip(gold, pred))
    fn = sum(g == pos and p != pos for g, p in zip(gold, pred))
    tn = len(gold) - tp - fp - fn
    f = lambda p, r: div(2 * p * r, p + r)
    p1, r1, p0, r0 = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fn), div(tn, tn + fp)
    n = len(gold)
    return {"accuracy": div(tp + tn, n), "precision": p1, "recall": r1, "f1": f(p1, r1), "macro_f1": (f(p1, r1) + f(p0, r0)) / 2,
            "weighted_f1": div(f(p1, r1) * (tp + fn) + f(p0, r0) * (fp + tn), n)}


@pytest.mark.parametrize("metric", metrics.METRICS)
def test_tuning_matches_a_sweep(spark, metric):
    rng = random.Random(metric)
    gold = [rng.choice(SARCASM_LABELS) for _ in range(150)]
    score = [rng.choice([rng.random(), round(rng.random(), 2), 0.0, 1.0]) for _ in gold]
    best = None
    for i in range(101):
        t = i / 100
        value = plain_binary(gold, ["sarcastic" if s >= t else "non-sarcastic" for s in score], "sarcastic")[metric]
        if best is None or value > best[1] or (value == best[1] and abs(t - 0.5) < abs(best[0] - 0.5)):
            best = (t, value)
    df = spark.createDataFrame(list(zip(gold, score)), "gold string, score double")
    got = metrics.tune_threshold(df, "sarcastic", metric).first()
    assert (got["threshold"], got["metric_value"]) == pytest.approx(best)


def test_single_row_tunes_to_half(spark):
    df = spark.createDataFrame([("sarcastic", 0.9)], "gold string, score double")
    assert metrics.tune_threshold(df, "sarcastic").first()["threshold"] == 0.5


def test_sarcasm_evaluation(spark):
    df = spark.createDataFrame([("sarcastic", 0.9), ("non-sarcastic", 0.1)], "gold string, score double")
    row = metrics.sarcasm_evaluation(df).first()
    assert (row["samples"], row["accuracy"], row["f1"]) == (2, 1.0, 1.0)


def test_multiclass_with_absent_label(spark):
    df = spark.createDataFrame([("neutral", "neutral"), ("negative", "neutral")], "gold string, predicted string")
    row = metrics.multiclass_metrics(df, FINAL_LABELS).first()
    assert row["accuracy"] == 0.5 and row["macro_f1"] == pytest.approx((2 / 3) / 3)
    assert [r["support"] for r in metrics.label_metrics(df, FINAL_LABELS).orderBy("label_no").collect()] == [1, 1, 0]


def test_kappa(spark):
    # counts per row over two categories: (3,0) (2,1) (0,3) (1,2)
    rows = [("a", "x", "x", "x"), ("b", "x", "x", "y"), ("c", "y", "y", "y"), ("d", "x", "y", "y"), ("e", "x", None, "y")]
    df = spark.createDataFrame(rows, "post_id string, t_k string, t_p string, t_w string")
    row = agreement.fleiss_kappa(df, ["t"], ["k", "p", "w"]).first()
    observed, chance = (1 + 1 / 3 + 1 + 1 / 3) / 4, 0.5 ** 2 + 0.5 ** 2
    assert row["n"] == 4 and row["kappa"] == pytest.approx((observed - chance) / (1 - chance)) and row["band"] == "fair"
    same = spark.createDataFrame([("a", "x", "x", "x")], "post_id string, t_k string, t_p string, t_w string")
    assert agreement.fleiss_kappa(same, ["t"], ["k", "p", "w"]).first()["kappa"] is None


def test_training_and_ablation(spark):
    words = {"neutral": "report about numbers", "negative": "terrible useless waste", "positive": "love great amazing"}
    rows = [(f"{l}{i}", f"{w} {i % 5} tools", FINAL_LABELS.index(l), l) for l, w in words.items() for i in range(20)]
    split = dataset.stratified_split(spark.createDataFrame(rows, "post_id string, text string, label int, label_name string"))
    stages = dataset.derive_stage_rows(split)
    out = {r["variant"]: r for r in training.ablation_compare(stages, jobs.untrained_two_stage, max_iter=10, grid=(0.01,)).collect()}
    assert set(out) == {"hierarchical_trained", "no_training", "no_hierarchy"}
    assert out["no_hierarchy"]["accuracy"] == 1.0 and out["hierarchical_trained"]["accuracy"] == 1.0


def test_split_is_the_same_however_many_labels(spark, monkeypatch):
    rows = [(f"p{i}", "hot" if i % 3 == 0 else f"l{i % 17}") for i in range(900)]
    df = spark.createDataFrame(rows, "post_id string, label string")
    few = sorted(map(tuple, dataset.stratified_split(df, ratio=0.3).collect()))
    monkeypatch.setattr(dataset, "MAX_BROADCAST_ROWS", 3)
    assert sorted(map(tuple, dataset.stratified_split(df, ratio=0.3).collect())) == few


WORDS = {"neutral": "report about numbers", "negative": "terrible useless waste", "positive": "love great amazing"}


@pytest.fixture(scope="module")
def labelled_stages(spark):
    rows = [(f"{l}{i}", f"{w} {i % 5} tools", FINAL_LABELS.index(l), l) for l, w in WORDS.items() for i in range(30)]
    split = dataset.stratified_split(spark.createDataFrame(rows, "post_id string, text string, label int, label_name string"), ratio=0.4)
    return dataset.derive_stage_rows(split).cache()


@pytest.mark.parametrize("learner", ["counts", "epochs"])
def test_stored_models_predict_as_they_were_trained(spark, labelled_stages, tmp_path, learner):
    out = {r["stage"]: r for r in training.fit_hierarchy(labelled_stages, str(tmp_path), learner=learner).collect()}
    assert {s: (r["train_rows"], r["validation_rows"]) for s, r in out.items()} == {"subjectivity": (54, 36), "polarity": (36, 24)}
    assert out["polarity"]["macro_f1"] == 1.0
    finals = labelled_stages.where("stage = 'final_label' and split = 'validation'").select("post_id", "text", "label_name")
    assert training.predict_stored(finals, str(tmp_path)).where("final_label <> label_name").count() == 0
    config = {r["stage"]: r for r in training.stored_config(spark, str(tmp_path)).collect()}
    assert {s: r["decision_threshold"] for s, r in config.items()} == {s: r["selected_threshold"] for s, r in out.items()}
    counts = {r["stage"]: r["total"] for r in spark.read.parquet(f"{tmp_path}/stage_counts").collect()}
    assert counts == {"final_label": 90, "subjectivity": 90, "polarity": 60}


def test_early_stopping_keeps_the_best_epoch(spark, labelled_stages):
    from voxtide.operators import classifiers

    rows = labelled_stages.where("stage = 'polarity'").select("text", "label_name", "split").cache()
    train, validation = rows.where("split = 'train'"), rows.where("split = 'validation'")
    model = classifiers.fit_epochs(train, validation, ["negative", "positive"], epochs=20, patience=2)
    assert 0 < model.best_epoch <= model.epochs <= model.best_epoch + 2 < 20
    # labels turned round on the validation rows: nothing is gained, the first model stays
    turned = validation.withColumn("label_name", F.when(F.col("label_name") == "positive", "negative").otherwise("positive"))
    model = classifiers.fit_epochs(train, turned, ["negative", "positive"], epochs=20, patience=2)
    assert (model.epochs, model.best_epoch) == (2, 0) and not model.weights[:-1].any()
    none = classifiers.fit_epochs(train.limit(0), validation, ["negative", "positive"])
    assert none.epochs == 0 and not none.weights.any()


def test_counted_scores_are_naive_bayes(spark):
    from voxtide.operators import classifiers

    train = spark.createDataFrame([("good good fun", "positive"), ("good day", "positive"), ("bad day", "negative"), (None, "negative")], "text string, label_name string")
    model = classifiers.fit_counts(train, ["negative", "positive"])
    rows = spark.createDataFrame([(1, "good day"), (2, "unseen words"), (3, ""), (4, None)], "post_id long, text string")
    got = {r["post_id"]: r["scores"]["positive"] for r in model.scores(rows).collect()}
    # 4 terms; positive: good 2, fun 1, day 1; negative: bad 1, day 1
    p, n = (3 / 8) * (2 / 8), (1 / 6) * (2 / 6)
    assert got == {1: round(p / (p + n), 6), 2: 0.5, 3: 0.5, 4: 0.5}


def test_comparison_leaves_out_what_chose_the_models(spark, labelled_stages, tmp_path):
    rows = training.held_apart(labelled_stages)
    parts = {r[0]: r[1] for r in rows.where("stage = 'final_label'").groupBy("split").count().collect()}
    assert parts["train"] == 54 and parts["validation"] + parts["test"] == 36 and min(parts.values()) > 5
    out = {r["variant"]: r["accuracy"] for r in training.compare_on_test(labelled_stages, jobs.untrained_two_stage, str(tmp_path)).collect()}
    assert out["hierarchical_trained"] == out["no_hierarchy"] == 1.0 >= out["no_training"]

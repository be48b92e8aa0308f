"""Classifier training on a fixed split with pyspark.ml."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.operators.classifiers import fit_counts, fit_epochs, load_model, read_config, save_model
from voxtide.operators.dataset import label_anomalies, stage_counts
from voxtide.operators.labels import at_least, hierarchical_predict, score_map, with_label_config
from voxtide.operators.metrics import METRICS, binary_metrics, multiclass_metrics, side_by_side, tune_threshold
from voxtide.schema import FINAL_LABELS, POLARITY_LABELS, SUBJECTIVITY_LABELS

REG_GRID = (0.01, 0.1)
FEATURES = 1 << 16


def _features() -> list:
    return [
        RegexTokenizer(inputCol="text", outputCol="_tok", pattern="[^\\p{L}\\p{N}_]+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=FEATURES),
        IDF(inputCol="_tf", outputCol="_features"),
    ]


def fit_best(train: DataFrame, validation: DataFrame, labels: list[str], metric: str = "macro_f1",
             grid: tuple[float, ...] = REG_GRID, max_iter: int = 20) -> tuple[PipelineModel, float]:
    """The model of the grid that scores best on the validation rows. Features
    are fitted once; the driver sees one metric value per candidate."""
    prep = Pipeline(stages=_features()).fit(train)
    vectors = prep.transform(train).select("_features", F.col("label").cast("double").alias("label")).persist()
    check = prep.transform(validation).persist()
    best: tuple[PipelineModel, float] | None = None
    names = F.array(*[F.lit(l) for l in labels])
    for reg in grid:
        family = "binomial" if len(labels) == 2 else "multinomial"
        model = LogisticRegression(featuresCol="_features", labelCol="label", regParam=reg, maxIter=max_iter,
                                   family=family).fit(vectors)
        pred = model.transform(check).select(
            F.col("label_name").alias("gold"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))
        value = multiclass_metrics(pred, labels).select(metric).first()[0]
        if best is None or value > best[1]:
            best = (PipelineModel(stages=[*prep.stages, model]), value)
    vectors.unpersist()
    check.unpersist()
    return best


def model_scores(model: PipelineModel, labels: list[str], df: DataFrame) -> DataFrame:
    """df plus `scores`: map label -> probability."""
    scored = model.transform(df).withColumn("_p", vector_to_array("probability"))
    present = model.stages[-1].numClasses
    return scored.select(*df.columns, score_map(
        labels, [F.get(F.col("_p"), F.lit(i)) if i < present else F.lit(0.0) for i in range(len(labels))]).alias("scores"))


def train_stage(rows: DataFrame, labels: list[str], positive: str, threshold_metric: str = "macro_f1",
                **kwargs) -> tuple[PipelineModel, DataFrame]:
    """(model, metrics): a two-class stage and its validation metrics at the
    default threshold together with the tuned one."""
    train, validation = (rows.where(F.col("split") == s).drop("split") for s in ("train", "validation"))
    model, _ = fit_best(train, validation, labels, **kwargs)
    scored = model_scores(model, labels, validation).select(
        F.col("label_name").alias("gold"), F.element_at("scores", positive).alias("score"))
    other = next(l for l in labels if l != positive)
    plain = binary_metrics(scored.withColumn("predicted", F.when(at_least(F.col("score"), 0.5), positive).otherwise(other)), positive)
    tuned = tune_threshold(scored, positive, threshold_metric).select(
        F.col("threshold").alias("selected_threshold"), F.col("metric_value").alias("threshold_metric_value"))
    return model, side_by_side(plain.select(*METRICS), tuned)


def train_hierarchical(stage_rows: DataFrame, **kwargs) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Both stages from derived stage rows; metrics carry a stage column."""
    plan = {"subjectivity": (SUBJECTIVITY_LABELS, "opinionated"), "polarity": (POLARITY_LABELS, "positive")}
    models, metrics = {}, []
    for stage, (labels, positive) in plan.items():
        rows = stage_rows.where(F.col("stage") == stage).drop("stage")
        models[stage], m = train_stage(rows, labels, positive, **kwargs)
        metrics.append(m.withColumn("stage", F.lit(stage)))
    return models, reduce(DataFrame.unionByName, metrics)


def train_flat(stage_rows: DataFrame, **kwargs) -> tuple[PipelineModel, DataFrame]:
    """One three-class classifier on the same split."""
    rows = stage_rows.where(F.col("stage") == "final_label").drop("stage")
    train, validation = (rows.where(F.col("split") == s).drop("split") for s in ("train", "validation"))
    model, _ = fit_best(train, validation, FINAL_LABELS, **kwargs)
    return model, multiclass_metrics(predict_flat(model, validation), FINAL_LABELS)


def predict_flat(model: PipelineModel, rows: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(l) for l in FINAL_LABELS])
    return model.transform(rows).select(
        "post_id", F.col("label_name").alias("gold"), F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"))


def predict_hierarchical(models: dict[str, PipelineModel], rows: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    return hierarchical_predict(
        rows,
        lambda d: model_scores(models["subjectivity"], SUBJECTIVITY_LABELS, d),
        lambda d: model_scores(models["polarity"], POLARITY_LABELS, d),
        thresholds["subjectivity"], thresholds["polarity"],
    )


def ablation_compare(stage_rows: DataFrame, untrained, **kwargs) -> DataFrame:
    """variant, accuracy, macro_f1, weighted_f1 of three variants on one shared
    validation split: trained hierarchy, untrained scoring, trained flat model.
    `untrained` takes rows (post_id, text, label_name) and returns gold/predicted."""
    finals = stage_rows.where((F.col("stage") == "final_label") & (F.col("split") == "validation")).drop("stage", "split")
    models, metrics = train_hierarchical(stage_rows, **kwargs)
    thresholds = {r["stage"]: r["selected_threshold"] for r in metrics.select("stage", "selected_threshold").collect()}
    two_stage = predict_hierarchical(models, finals, thresholds).select(
        F.col("label_name").alias("gold"), F.col("final_label").alias("predicted"))
    flat_model, _ = train_flat(stage_rows, **kwargs)
    variants = {
        "hierarchical_trained": two_stage,
        "no_training": untrained(finals),
        "no_hierarchy": predict_flat(flat_model, finals),
    }
    return reduce(DataFrame.unionByName, [
        multiclass_metrics(d, FINAL_LABELS).select(F.lit(v).alias("variant"), "accuracy", "macro_f1", "weighted_f1")
        for v, d in variants.items()
    ])


# ---- stored models ------------------------------------------------------------------

STAGES = {"subjectivity": (SUBJECTIVITY_LABELS, "opinionated"), "polarity": (POLARITY_LABELS, "positive")}


def stage_score(model, labels: list[str], positive: str, rows: DataFrame) -> DataFrame:
    """gold, predicted at 0.5 and score of the positive label of labelled rows."""
    scored = model.scores(rows).select(F.col("label_name").alias("gold"), F.element_at("scores", positive).alias("score"))
    other = next(l for l in labels if l != positive)
    return scored.withColumn("predicted", F.when(at_least(F.col("score"), 0.5), positive).otherwise(other))


def fit_stage(rows: DataFrame, stage: str, path: str, learner: str = "epochs", metric: str = "macro_f1", **kwargs) -> DataFrame:
    """Train one two-class stage on its rows (post_id, text, label_name, split), choose
    the threshold on the validation rows and write model, threshold and labels below
    `path`. Returns one row: the stage, its counts, the share of the label most
    validation rows have, the metrics at 0.5, the threshold chosen and the epochs."""
    labels, positive = STAGES[stage]
    train, validation = (rows.where(F.col("split") == s) for s in ("train", "validation"))
    model = fit_epochs(train, validation, labels, metric, **kwargs) if learner == "epochs" else fit_counts(train, labels, **kwargs)
    scored = stage_score(model, labels, positive, validation)
    # two rows of numbers: found once, then kept as a row of literals
    tuned = tune_threshold(scored, positive, metric).select("threshold", "metric_value").first()
    save_model(model, path, rows.sparkSession, stage, positive, tuned["threshold"], metric, tuned["metric_value"])
    counts = rows.agg(
        F.count_if(F.col("split") == "train").alias("train_rows"), F.count_if(F.col("split") == "validation").alias("validation_rows"),
        *[F.count_if((F.col("split") == "validation") & (F.col("label_name") == l)).alias(f"_n{i}") for i, l in enumerate(labels)])
    counts = counts.select("train_rows", "validation_rows", (F.greatest("_n0", "_n1") / F.nullif("validation_rows", F.lit(0))).alias("majority_accuracy"))
    out = side_by_side(counts, binary_metrics(scored, positive).select(*METRICS))
    return out.select(
        F.lit(stage).alias("stage"), "*", F.lit(tuned["threshold"]).alias("selected_threshold"),
        F.lit(tuned["metric_value"]).alias("threshold_metric_value"), F.lit(model.epochs).alias("epochs"), F.lit(model.best_epoch).alias("best_epoch"))


def fit_hierarchy(stage_rows: DataFrame, path: str, label_rows: DataFrame | None = None, learner: str = "epochs", **kwargs) -> DataFrame:
    """Both stages from derived stage rows, each stored in a folder of its own below
    `path`, next to `stage_counts` and, where the label rows are given, `anomalies`.
    Returns the metrics, one row a stage."""
    out = [fit_stage(stage_rows.where(F.col("stage") == s).drop("stage"), s, os.path.join(path, s), learner, **kwargs) for s in STAGES]
    stage_counts(stage_rows).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "stage_counts"))
    if label_rows is not None:
        label_anomalies(label_rows).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "anomalies"))
    return reduce(DataFrame.unionByName, out)


def stored_config(spark: SparkSession, path: str) -> DataFrame:
    """Labels, positive label and threshold of the stages stored below `path`."""
    stages = spark.createDataFrame([(s, *of) for s, of in STAGES.items()], "stage string, default_labels array<string>, default_positive string")
    return with_label_config(stages, read_config(spark, *[os.path.join(path, s) for s in STAGES]))


def predict_stored(rows: DataFrame, path: str) -> DataFrame:
    """Two-stage labels of rows by the models and thresholds stored below `path`."""
    spark = rows.sparkSession
    config = {r["stage"]: r for r in stored_config(spark, path).collect()}  # two rows
    models = {s: load_model(spark, os.path.join(path, s)) for s in STAGES}
    one, two = config["subjectivity"], config["polarity"]
    return hierarchical_predict(rows, models["subjectivity"].scores, models["polarity"].scores, one["decision_threshold"], two["decision_threshold"],
                                one["labels"], one["positive_label"], two["labels"], two["positive_label"])


def top_label(scores: str, labels: list[str]) -> Column:
    """The label with the highest score, the first one on ties."""
    best = F.greatest(*[F.element_at(scores, l) for l in labels])
    return F.coalesce(*[F.when(F.element_at(scores, l) == best, l) for l in labels])


def held_apart(rows: DataFrame, key: str = "post_id") -> DataFrame:
    """Rows of a split whose validation half is cut in two by a hash of the key:
    `validation` chooses models and thresholds, `test` is looked at once."""
    odd = F.ascii(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(":test")).cast("binary")), 32, 1)) % 2 == 1
    return rows.withColumn("split", F.when((F.col("split") == "validation") & odd, "test").otherwise(F.col("split")))


def compare_on_test(stage_rows: DataFrame, untrained, path: str, learner: str = "counts", **kwargs) -> DataFrame:
    """The variants of `ablation_compare` with stored models, measured on rows that
    chose neither a model nor a threshold. variant, accuracy, macro_f1, weighted_f1."""
    rows = held_apart(stage_rows)
    finals = rows.where(F.col("stage") == "final_label").drop("stage")
    test = finals.where(F.col("split") == "test").select("post_id", "text", "label_name")
    fit_hierarchy(rows, path, learner=learner, **kwargs)
    flat = fit_counts(finals.where(F.col("split") == "train"), FINAL_LABELS)
    variants = {
        "hierarchical_trained": predict_stored(test, path).select(F.col("label_name").alias("gold"), F.col("final_label").alias("predicted")),
        "no_training": untrained(test),
        "no_hierarchy": flat.scores(test).select(F.col("label_name").alias("gold"), top_label("scores", FINAL_LABELS).alias("predicted")),
    }
    return reduce(DataFrame.unionByName, [
        multiclass_metrics(d, FINAL_LABELS).select(F.lit(v).alias("variant"), "accuracy", "macro_f1", "weighted_f1") for v, d in variants.items()])

"""Classifier metrics from counts: one pass over the rows, then arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxtide.operators.labels import at_least

METRICS = ["accuracy", "precision", "recall", "f1", "macro_f1", "weighted_f1"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0"""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def confusion(df: DataFrame, positive: str, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    g, p = F.col(gold) == positive, F.col(predicted) == positive
    return df.agg(
        F.count_if(g & p).alias("true_positive"), F.count_if(~g & p).alias("false_positive"),
        F.count_if(~g & ~p).alias("true_negative"), F.count_if(g & ~p).alias("false_negative"),
    )


def from_confusion(counts: DataFrame) -> DataFrame:
    """All binary metrics from the four counts. The micro figures are those of
    the positive class."""
    tp, fp, tn, fn = (F.col(c) for c in ("true_positive", "false_positive", "true_negative", "false_negative"))
    pos, neg, total = tp + fn, fp + tn, tp + fp + tn + fn
    step1 = counts.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "_np": ratio(tn, tn + fn), "_nr": ratio(tn, tn + fp),
        "accuracy": ratio(tp + tn, total),
    })
    step2 = step1.withColumns({
        "f1": f1(F.col("precision"), F.col("recall")), "_nf": f1(F.col("_np"), F.col("_nr")),
    })
    pairs = {"precision": "_np", "recall": "_nr", "f1": "_nf"}
    out = step2.withColumns({f"macro_{m}": (F.col(m) + F.col(n)) / 2 for m, n in pairs.items()})
    out = out.withColumns({f"weighted_{m}": ratio(F.col(m) * pos + F.col(n) * neg, total) for m, n in pairs.items()})
    return out.withColumns({f"micro_{m}": F.col(m) for m in pairs}).withColumns({
        "negative_precision": F.col("_np"), "negative_recall": F.col("_nr"), "negative_f1": F.col("_nf"),
        "positive_support": pos, "negative_support": neg,
    }).drop("_np", "_nr", "_nf")


def binary_metrics(df: DataFrame, positive: str, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    return from_confusion(confusion(df, positive, gold, predicted))


def label_metrics(df: DataFrame, labels: list[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    """label_no, label, support, precision, recall, f1 for a fixed label list; labels
    that do not occur count with zeros."""
    matrix = df.groupBy(F.col(gold).alias("_g"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))

    def n(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))

    aggs = []
    for i, l in enumerate(labels):
        g, p = F.coalesce(F.col("_g") == l, F.lit(False)), F.coalesce(F.col("_p") == l, F.lit(False))
        aggs += [n(g & p).alias(f"tp{i}"), n(~g & p).alias(f"fp{i}"), n(g & ~p).alias(f"fn{i}")]
    right = n(F.col("_g") == F.col("_p")).alias("right")
    wide = matrix.agg(*aggs, right, n(F.lit(True)).alias("total"))
    rows = F.array(*[
        F.struct(F.lit(i).alias("label_no"), F.lit(l).alias("label"), F.col(f"tp{i}").alias("tp"),
                 F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"))
        for i, l in enumerate(labels)
    ])
    flat = wide.select("right", "total", F.explode(rows).alias("r")).select("right", "total", "r.*")
    flat = flat.withColumns({
        "support": F.col("tp") + F.col("fn"),
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
    })
    return flat.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def multiclass_metrics(df: DataFrame, labels: list[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    per_label = label_metrics(df, labels, gold, predicted)
    n_labels = max(1, len(labels))
    aggs = [ratio(F.max("right"), F.max("total")).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggs.append((F.sum(m) / n_labels).alias(f"macro_{m}"))
        aggs.append(ratio(F.sum(F.col(m) * F.col("support")), F.max("total")).alias(f"weighted_{m}"))
    return per_label.agg(*aggs)


def classification_report(df: DataFrame, labels: list[str], gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    rows = label_metrics(df, labels, gold, predicted)
    return rows.select(
        "label", *[F.round(m, 3).alias(m) for m in ("precision", "recall", "f1")], "support",
        F.round(ratio(F.col("right"), F.col("total")), 3).alias("accuracy"),
    )


def threshold_sweep(df: DataFrame, positive: str, gold: str = "gold", score: str = "score", steps: int = 101) -> DataFrame:
    """threshold plus all binary metrics for every threshold i / (steps - 1).

    Each score is put to the largest threshold it reaches; suffix sums over that
    histogram of at most steps + 1 rows give the counts at every threshold, so
    the rows are read once instead of once per threshold.
    """
    steps = max(2, steps)
    last = steps - 1
    s = F.col(score)
    guess = F.least(F.greatest(F.floor(s * last), F.lit(-1)), F.lit(last))
    # floor() of a product may be one off the comparison it stands for
    index = (
        F.when(F.isnan(s) | s.isNull(), F.lit(-1))
        .when((guess < last) & at_least(s, (guess + 1) / F.lit(float(last))), guess + 1)
        .when((guess >= 0) & ~at_least(s, guess / F.lit(float(last))), guess - 1)
        .otherwise(guess)
    ).cast("int")
    is_pos = F.col(gold) == positive
    hist = df.groupBy(index.alias("_i")).agg(F.count_if(is_pos).alias("_p"), F.count_if(~is_pos).alias("_n"))
    grid = df.sparkSession.range(-1, steps).select(F.col("id").cast("int").alias("_i"))
    full = grid.join(hist, "_i", "left").select("_i", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("_p", "_n")])
    one = W.partitionBy(F.lit(1))
    above = one.orderBy("_i").rowsBetween(0, W.unboundedFollowing)
    counts = full.select(
        "_i",
        F.sum("_p").over(above).alias("true_positive"), F.sum("_n").over(above).alias("false_positive"),
        F.sum("_p").over(one).alias("_tp"), F.sum("_n").over(one).alias("_tn"),
    ).where(F.col("_i") >= 0)
    counts = counts.select(
        (F.col("_i") / F.lit(float(last))).alias("threshold"), "true_positive", "false_positive",
        (F.col("_tn") - F.col("false_positive")).alias("true_negative"),
        (F.col("_tp") - F.col("true_positive")).alias("false_negative"),
    )
    return from_confusion(counts)


def tune_threshold(df: DataFrame, positive: str, metric: str = "macro_f1", gold: str = "gold",
                   score: str = "score", steps: int = 101) -> DataFrame:
    """Best threshold by a metric; ties go to the one nearest 0.5, then the lower."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    sweep = threshold_sweep(df, positive, gold, score, steps)
    best = sweep.orderBy(F.desc(metric), F.abs(F.col("threshold") - 0.5), "threshold").limit(1)
    return best.withColumn("metric_name", F.lit(metric)).withColumn("metric_value", F.col(metric))


def sarcasm_evaluation(df: DataFrame, threshold: float = 0.5, metric: str = "f1", steps: int = 101,
                       gold: str = "gold", score: str = "score") -> DataFrame:
    """Binary metrics at a threshold next to the recommended threshold, one row."""
    labelled = df.withColumn("predicted", F.when(at_least(F.col(score), threshold), "sarcastic").otherwise("non-sarcastic"))
    at = binary_metrics(labelled, "sarcastic", gold).select(
        (F.col("positive_support") + F.col("negative_support")).alias("samples"),
        F.lit(threshold).alias("threshold"), *METRICS)
    best = tune_threshold(df, "sarcastic", metric, gold, score, steps).select(
        F.col("threshold").alias("best_threshold"), F.col("metric_name").alias("best_threshold_metric"),
        F.col("metric_value").alias("best_threshold_metric_value"))
    return side_by_side(at, best)


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row tables as one row, without a join: stacked, then folded."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def compare_models(left: DataFrame, right: DataFrame, key: str = "task") -> DataFrame:
    """accuracy and macro_f1 of two metric tables side by side."""
    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(key, F.col("accuracy").alias(f"accuracy_{suffix}"), F.col("macro_f1").alias(f"macro_f1_{suffix}"))

    both = side(left, "a").unionByName(side(right, "b"), allowMissingColumns=True)
    values = [c for c in both.columns if c != key]
    out = both.groupBy(key).agg(*[F.max(c).alias(c) for c in values])
    out = out.where(F.col("accuracy_a").isNotNull() & F.col("accuracy_b").isNotNull())
    return out.withColumn("accuracy_gain", F.col("accuracy_b") - F.col("accuracy_a")).withColumn(
        "macro_f1_gain", F.col("macro_f1_b") - F.col("macro_f1_a"))

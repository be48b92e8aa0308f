"""Trained text classifiers that can be written, read back and used again.

Two learners. `fit_counts` counts in how many texts of a label each term stands
(naive Bayes); its weights are a table. `fit_epochs` takes full-batch steps on
hashed terms with early stopping and keeps the best epoch; its weights are at most
FEATURES numbers, whatever the input. `voxtide.operators.training` has a third one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.functions.text import as_col, tokens
from voxtide.operators.labels import score_map
from voxtide.operators.metrics import METRICS, from_confusion
from voxtide.operators.skew import attach_lookup
from voxtide.operators.votes import softmax
from voxtide.session import cut_lineage

FEATURES = 1 << 16
CONFIG = ("stage string, kind string, labels array<string>, positive_label string, decision_threshold double, "
          "threshold_metric string, threshold_metric_value double, prior array<double>, epochs int, best_epoch int")


def terms(text: Column | str) -> Column:
    """The distinct lower-cased word tokens of a text; none for null."""
    return F.coalesce(F.array_distinct(tokens(F.lower(as_col(text)))), F.array().cast("array<string>"))


# ---- counts -------------------------------------------------------------------------


@dataclass
class CountModel:
    """`prior` per label and a table (term, w0..wn-1) of log likelihoods."""

    labels: list[str]
    prior: list[float]
    weights: DataFrame
    kind: str = "counts"
    epochs: int = 1
    best_epoch: int = 1

    def scores(self, df: DataFrame, key: str = "post_id", text: str = "text") -> DataFrame:
        """df plus `scores`: map label -> probability. `key` must be unique. Terms
        travel with the key alone; the heaviest terms are met by broadcast."""
        names = [f"w{i}" for i in range(len(self.labels))]
        rows = df.select(F.col(key).alias("_key"), F.explode(terms(text)).alias("term"))
        sums = attach_lookup(rows, self.weights, "term", names).groupBy("_key").agg(*[F.sum(n).alias(f"_{n}") for n in names])
        joined = df.join(sums, F.col(key) == F.col("_key"), "left")
        total = F.array(*[F.lit(p) + F.coalesce(F.col(f"_{n}"), F.lit(0.0)) for p, n in zip(self.prior, names)])
        joined = joined.select(*df.columns, softmax(total).alias("_p"))
        return joined.select(*df.columns, score_map(self.labels, [F.round(F.get("_p", F.lit(i)), 6) for i in range(len(self.labels))]).alias("scores"))


def fit_counts(train: DataFrame, labels: list[str], alpha: float = 1.0, text: str = "text", label: str = "label_name") -> CountModel:
    """Naive Bayes over the terms of a text, each counted once, with `alpha` added to
    every count. One pass that counts rows and one that counts terms by label, with
    map-side combine; the driver sees the totals. A label without rows keeps the
    prior of one row, so that it can be scored."""
    per_label = {r[0]: r[1] for r in train.where(F.col(label).isin(labels)).groupBy(label).count().collect()}
    n = [max(per_label.get(l, 0), 1) for l in labels]
    counts = cut_lineage(
        train.where(F.col(label).isin(labels)).select(label, F.explode(terms(text)).alias("term"))
        .groupBy("term").agg(*[F.count_if(F.col(label) == l).alias(f"c{i}") for i, l in enumerate(labels)]))
    size = counts.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)) for i in range(len(labels))]).first()
    weights = counts.select("term", *[
        F.log((F.col(f"c{i}") + F.lit(alpha)) / F.lit(float(size[i + 1] + alpha * size[0]))).alias(f"w{i}") for i in range(len(labels))])
    return CountModel(list(labels), [float(np.log(x / sum(n))) for x in n], weights)


# ---- epochs -------------------------------------------------------------------------


@dataclass
class EpochModel:
    """Weights of the second label against the first over hashed terms; the last
    one is the constant."""

    labels: list[str]
    weights: np.ndarray
    epochs: int = 0
    best_epoch: int = 0
    kind: str = "epochs"

    def scores(self, df: DataFrame, key: str = "post_id", text: str = "text") -> DataFrame:
        """df plus `scores`: map label -> probability. One pass, nothing is shuffled."""
        weights = self.weights

        @F.pandas_udf("double")
        def second(xs: pd.Series) -> pd.Series:
            return pd.Series(_probability(*_flat(xs), weights), index=xs.index)

        joined = df.withColumn("_p", F.round(second(hashed(text)), 6))
        return joined.select(*df.columns, score_map(self.labels, [1 - F.col("_p"), "_p"]).alias("scores"))


def hashed(text: Column | str) -> Column:
    """Slots of the terms of a text."""
    return F.transform(terms(text), lambda t: F.pmod(F.xxhash64(t), F.lit(FEATURES)).cast("int"))


def _flat(xs) -> tuple[np.ndarray, np.ndarray]:
    """(all slots, number of slots of each row)"""
    lengths = np.fromiter((len(x) for x in xs), np.int64, len(xs))
    return (np.concatenate(list(xs)).astype(np.int64) if len(xs) else np.empty(0, np.int64)), lengths


def _probability(slots: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A text's slots count 1 / sqrt(their number) each."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    z = np.bincount(owner, weights[slots], len(lengths)) / np.sqrt(np.maximum(lengths, 1)) + weights[-1]
    return 1 / (1 + np.exp(-z))


def _pass(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, dict[str, int]]:
    """(gradient over the train rows, confusion counts of the validation rows), summed
    by slot before they reach the driver: at most FEATURES + 5 rows."""
    width = len(weights)
    cells = ["true_negative", "false_positive", "false_negative", "true_positive"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width + len(cells))
        for batch in batches:
            xs = batch["x"]
            slots = xs.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            lengths = np.diff(xs.offsets.to_numpy()).astype(np.int64)
            y = batch["y"].to_numpy(zero_copy_only=False).astype(np.int64)
            check = batch["check"].to_numpy(zero_copy_only=False).astype(bool)
            p = _probability(slots, lengths, weights)
            off = np.where(check, 0.0, p - y)
            share = np.repeat(off / np.sqrt(np.maximum(lengths, 1)), lengths)
            total[:width - 1] += np.bincount(slots, share, width - 1)
            total[width - 1] += off.sum()
            total[width:] += np.bincount((2 * y + (p >= 0.5))[check], minlength=len(cells))
        used = np.flatnonzero(total)
        yield pa.record_batch({"slot": pa.array(used, pa.int32()), "v": pa.array(total[used])})

    found = rows.mapInArrow(run, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).toPandas()
    total = np.zeros(width + len(cells))
    total[found["slot"].to_numpy(np.int64)] = found["v"].to_numpy(float)
    return total[:width], {c: int(round(v)) for c, v in zip(cells, total[width:])}


def fit_epochs(train: DataFrame, validation: DataFrame, labels: list[str], metric: str = "macro_f1", epochs: int = 30, patience: int = 3,
               min_gain: float = 0.0, rate: float = 0.5, decay: float = 1e-4, text: str = "text", label: str = "label_name") -> EpochModel:
    """Logistic regression of two labels in epochs, each one pass over all rows.

    Starts from the log odds of the labels, the model that gives every text the
    label most texts have, which counts as epoch 0. Stops when `patience` epochs
    in a row bring no gain over `min_gain` in the validation metric, and returns
    the weights of the best epoch. Steps are AdaGrad's with a pull to 0 of `decay`.
    The slots are written once to the shared folder and read by every epoch.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    both = train.withColumn("check", F.lit(False)).unionByName(validation.withColumn("check", F.lit(True)))
    rows = cut_lineage(both.where(F.col(label).isin(labels)).select(
        hashed(text).alias("x"), (F.col(label) == labels[1]).cast("int").alias("y"), "check"))
    seen = rows.where("not check").agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    weights = np.zeros(FEATURES + 1)
    if 0 < seen[1] < seen[0]:
        weights[-1] = np.log(seen[1] / (seen[0] - seen[1]))
    elif seen[0]:
        weights[-1] = 20.0 if seen[1] else -20.0
    steps, best, wait, epoch = np.zeros_like(weights), None, 0, 0
    while True:
        gradient, counts = _pass(rows, weights)
        one = rows.sparkSession.createDataFrame([tuple(counts.values())], [*counts])
        value = from_confusion(one).select(metric).first()[0]
        if best is None or value > best[0] + min_gain:
            best, wait = (value, weights.copy(), epoch), 0
        else:
            wait += 1
        if epoch == epochs or wait >= patience or not seen[0]:
            return EpochModel(list(labels), best[1], epoch, best[2])
        gradient = gradient / seen[0] + decay * weights
        steps += gradient ** 2
        weights = weights - rate * gradient / (np.sqrt(steps) + 1e-12)
        epoch += 1


# ---- store --------------------------------------------------------------------------


def save_model(model: CountModel | EpochModel, path: str, spark: SparkSession, stage: str, positive: str, threshold: float = 0.5,
               metric: str | None = None, value: float | None = None) -> None:
    """Weights and label configuration as Parquet below `path`; an earlier model
    there is replaced, its configuration last."""
    if model.kind == "counts":
        weights = model.weights
    else:
        used = np.flatnonzero(model.weights)
        weights = spark.createDataFrame(pd.DataFrame({"slot": used.astype("int32"), "w": model.weights[used]}), "slot int, w double")
    weights.write.mode("overwrite").parquet(os.path.join(path, "weights"))
    config = [(stage, model.kind, model.labels, positive, float(threshold), metric, value, list(getattr(model, "prior", [])), model.epochs, model.best_epoch)]
    spark.createDataFrame(config, CONFIG).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "label_config"))


def read_config(spark: SparkSession, *paths: str) -> DataFrame:
    """The label configurations of stored models, one row each."""
    return spark.read.schema(CONFIG).parquet(*[os.path.join(p, "label_config") for p in paths])


def load_model(spark: SparkSession, path: str) -> CountModel | EpochModel:
    config = read_config(spark, path).first()
    weights = spark.read.parquet(os.path.join(path, "weights"))
    if config["kind"] == "counts":
        return CountModel(config["labels"], config["prior"], weights)
    dense = np.zeros(FEATURES + 1)
    found = weights.toPandas()  # at most FEATURES + 1 rows
    dense[found["slot"].to_numpy(np.int64)] = found["w"].to_numpy(float)
    return EpochModel(config["labels"], dense, config["epochs"], config["best_epoch"])

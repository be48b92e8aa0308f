"""Labelled-dataset building: rows per stage, anomalies, exact stratified split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxtide.functions.text import as_col, half_even, utrim
from voxtide.operators.skew import attach_lookup
from voxtide.operators.votes import MAX_BROADCAST_ROWS
from voxtide.schema import FINAL_LABELS, POLARITY_LABELS, SUBJECTIVITY_LABELS
from voxtide.session import cut_lineage

# Anomaly counters, first match wins.
ANOMALIES = [
    "missing_text", "missing_subjectivity_label", "missing_polarity_label",
    "opinionated_with_neutral_polarity", "neutral_with_sentiment_polarity",
]


def load_manual_labels(df: DataFrame) -> DataFrame:
    """Every cell a stripped string, '' where missing; columns without a name dropped."""
    return df.select(*[
        F.coalesce(utrim(F.col(c).cast("string")), F.lit("")).alias(c) for c in df.columns if c.strip()
    ])


def choose_text(text: str = "text", cleaned: str = "cleaned_text") -> Column:
    empty = F.lit("")
    return F.coalesce(F.nullif(utrim(text), empty), utrim(cleaned), empty)


def label_index(label: Column | str, order: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(l) for l in order]), as_col(label)) - 1).cast("int")


def anomaly_code() -> Column:
    """The first anomaly of a stripped label row, or null."""
    sub, pol = F.col("subjectivity_detection"), F.col("polarity_detection")
    opinionated = sub == "opinionated"
    return (
        F.when(choose_text() == "", ANOMALIES[0])
        .when(sub == "", ANOMALIES[1])
        .when(opinionated & (pol == ""), ANOMALIES[2])
        .when(opinionated & (pol == "neutral"), ANOMALIES[3])
        .when((sub == "neutral") & pol.isin(POLARITY_LABELS), ANOMALIES[4])
    )


def _labelled(df: DataFrame, label: Column, order: list[str]) -> DataFrame:
    return df.select("post_id", choose_text().alias("text"), label_index(label, order).alias("label"), label.alias("label_name"))


def subjectivity_rows(df: DataFrame) -> DataFrame:
    sub = F.col("subjectivity_detection")
    return _labelled(df.where((choose_text() != "") & sub.isin(SUBJECTIVITY_LABELS)), sub, SUBJECTIVITY_LABELS)


def polarity_rows(df: DataFrame) -> DataFrame:
    pol = F.col("polarity_detection")
    keep = (choose_text() != "") & (F.col("subjectivity_detection") == "opinionated") & pol.isin(POLARITY_LABELS)
    return _labelled(df.where(keep), pol, POLARITY_LABELS)


def label_anomalies(df: DataFrame) -> DataFrame:
    code = anomaly_code()
    return df.agg(*[F.count_if(code == a).alias(a) for a in ANOMALIES])


def final_label_rows(df: DataFrame) -> DataFrame:
    """Three-class rows; neutral rows with a sentiment polarity are left out here."""
    sub, pol = F.col("subjectivity_detection"), F.col("polarity_detection")
    label = F.when((sub == "neutral") & ~pol.isin(POLARITY_LABELS), "neutral").when(
        (sub == "opinionated") & pol.isin(POLARITY_LABELS), pol)
    rows = df.where((choose_text() != "") & label.isNotNull())
    return _labelled(rows, label, FINAL_LABELS)


def derive_stage_rows(split_rows: DataFrame) -> DataFrame:
    """The subjectivity and polarity views of one shared split, as stage rows."""
    name = F.col("label_name")
    sub = F.when(name == "neutral", "neutral").otherwise("opinionated")
    stages = F.array(
        F.struct(F.lit("final_label").alias("stage"), name.alias("stage_label")),
        F.struct(F.lit("subjectivity").alias("stage"), sub.alias("stage_label")),
        F.struct(F.lit("polarity").alias("stage"), F.when(name != "neutral", name).alias("stage_label")),
    )
    flat = split_rows.select("post_id", "text", "split", F.explode(stages).alias("s")).where("s.stage_label is not null")
    stage, label = F.col("s.stage"), F.col("s.stage_label")
    index = (
        F.when(stage == "final_label", label_index(label, FINAL_LABELS))
        .when(stage == "subjectivity", label_index(label, SUBJECTIVITY_LABELS))
        .otherwise(label_index(label, POLARITY_LABELS))
    )
    return flat.select("post_id", "text", "split", stage.alias("stage"), index.alias("label"), label.alias("label_name"))


def validation_size(n: Column, ratio: float) -> Column:
    """How many of n rows of a label go to validation."""
    if ratio <= 0:
        return F.lit(0).cast("bigint")
    wanted = F.greatest(half_even(n * ratio).cast("bigint"), F.lit(1))
    return F.when(n <= 1, F.lit(0)).otherwise(F.least(wanted, n - 1)).cast("bigint")


def _of_label(rows: DataFrame, table: DataFrame, label: str, payload: list[str], few: bool) -> DataFrame:
    """rows with what a table of one row per label says: by broadcast while the labels
    are few, else by a shuffled join that scatters the heaviest labels."""
    return rows.join(F.broadcast(table), label, "left") if few else attach_lookup(rows, table, label, payload)


def stratified_split(df: DataFrame, label: str = "label", ratio: float = 0.2, seed: int = 42,
                     key: str = "post_id") -> DataFrame:
    """df plus `split`: per label exactly validation_size rows, chosen by the
    order of md5(key:seed). `key` must be unique.

    The k-th smallest hash of a label is found without ranking the label: a
    histogram over 65,536 hash prefixes gives the bucket that holds it, only
    that bucket's rows are ranked, and every row is then compared with one
    cut-off per label.
    """
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")))
    narrow = cut_lineage(hashed.select(label, "_h", F.substring("_h", 1, 4).alias("_b"), F.col(key).cast("string").alias("_key")))
    hist = narrow.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    per_label = W.partitionBy(label)
    upto = F.sum("_n").over(per_label.orderBy("_b").rowsBetween(W.unboundedPreceding, 0))
    wanted = validation_size(F.sum("_n").over(per_label), ratio)
    edge = cut_lineage(
        hist.select(label, F.col("_b").alias("_eb"), F.col("_n").alias("_en"), upto.alias("_upto"), wanted.alias("_k"))
        .where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_en") < F.col("_k")))
        .select(label, "_eb", (F.col("_k") - (F.col("_upto") - F.col("_en"))).alias("_need"))
    )
    # one row per label in both tables
    few = edge.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    in_edge = _of_label(narrow, edge, label, ["_eb", "_need"], few).where(F.col("_b") == F.col("_eb"))
    rank = F.row_number().over(W.partitionBy(label).orderBy("_h", "_key"))
    cut = in_edge.withColumn("_r", rank).where(F.col("_r") == F.col("_need")).select(
        label, F.col("_h").alias("_ch"), F.col("_key").alias("_ck"))
    joined = _of_label(hashed, cut, label, ["_ch", "_ck"], few)
    chosen = (F.col("_h") < F.col("_ch")) | ((F.col("_h") == F.col("_ch")) & (F.col(key).cast("string") <= F.col("_ck")))
    return joined.select(*df.columns, F.when(chosen, "validation").otherwise("train").alias("split"))


def stage_counts(stage_rows: DataFrame) -> DataFrame:
    """stage, total, train, validation"""
    return stage_rows.groupBy("stage").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("split") == "train").alias("train"),
        F.count_if(F.col("split") == "validation").alias("validation"),
    )


def save_splits(split_rows: DataFrame, path: str) -> None:
    split_rows.write.partitionBy("split").parquet(path)


def dropna_labels(df: DataFrame) -> DataFrame:
    """Rows with all three labels; cleaned text if there is any, else raw text."""
    labels = ["subjectivity_detection", "polarity_detection", "sarcasm_detection"]
    return df.dropna(subset=labels).withColumn("input_text", F.coalesce("cleaned_text", "text"))


def sarcasm_gold_rows(df: DataFrame) -> DataFrame:
    label = F.lower(utrim("sarcasm_detection"))
    return df.where(label.isin("sarcastic", "non-sarcastic") & (choose_text() != "")).select(
        "post_id", choose_text().alias("text"), label.alias("gold"))


def class_distribution(split_rows: DataFrame) -> DataFrame:
    return split_rows.groupBy("split", "label_name").agg(F.count(F.lit(1)).alias("n"))

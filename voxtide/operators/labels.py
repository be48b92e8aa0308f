"""Subjectivity, polarity and sarcasm labels; annotation of record sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from voxtide.functions import vocab
from voxtide.functions.text import as_col, half_even, utrim
from voxtide.operators.skew import attach_lookup, first_per_key
from voxtide.operators.state import pending_classification
from voxtide.schema import POLARITY_LABELS, SUBJECTIVITY_LABELS
from voxtide.session import cut_lineage


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


# ---- label spellings --------------------------------------------------------

def normalize_model_label(raw: Column | str, order: list[str], strict: bool = True) -> Column:
    """A known label, or label_<i> for the i-th of `order`; anything else is an
    error (strict) or null."""
    low = F.lower(utrim(raw))
    index = F.regexp_extract(low, "^label_(\\d+)$", 1).try_cast("int")
    named = F.when(low.isin(order), low).when(index < len(order), F.get(_names(order), index))
    if not strict:
        return named
    return F.when(as_col(raw).isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(named, F.raise_error(F.concat(F.lit("unsupported model label: "), as_col(raw))).cast("string")))


def normalize_sarcasm_label(raw: Column | str, strict: bool = True) -> Column:
    """Every accepted spelling, hypothesis sentences included, to the two labels."""
    text = utrim(raw)
    low = F.translate(F.lower(text), "_- ", "")
    out = F.lit(None).cast("string")
    for label, sentence in vocab.SARCASM_HYPOTHESES.items():
        out = F.when(text == sentence, label).otherwise(out)
    out = F.when(low.isin("sarcastic", "sarcasm"), "sarcastic").when(
        low.isin("nonsarcastic", "nonsarcasm", "notsarcastic"), "non-sarcastic").otherwise(out)
    if not strict:
        return out
    return F.when(as_col(raw).isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(out, F.raise_error(F.concat(F.lit("unsupported sarcasm label: "), as_col(raw))).cast("string")))


def evaluation_label(raw: Column | str) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in vocab.EVALUATION_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(mapping, as_col(raw)), F.translate(F.lower(as_col(raw)), "_", "-"))


# ---- thresholds ---------------------------------------------------------------

def other_label(order: list[str], positive: str) -> str:
    return next(l for l in order if l != positive)


def at_least(score: Column, threshold: Column | float) -> Column:
    """score >= threshold, false for NaN (Spark sorts NaN above every number)."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return ~F.isnan(score) & (score >= threshold)


def apply_threshold(score: Column | str, positive: str, order: list[str], threshold: Column | float) -> Column:
    return F.when(at_least(as_col(score), threshold), positive).otherwise(other_label(order, positive))


def binary_label_and_score(scores: Column | str, positive: str, order: list[str],
                           threshold: Column | float) -> tuple[Column, Column]:
    """(label, score of that label) from a map label -> score."""
    label = apply_threshold(F.element_at(as_col(scores), positive), positive, order, threshold)
    return label, F.element_at(as_col(scores), label)


def with_label_config(stages: DataFrame, config: DataFrame) -> DataFrame:
    """stages (stage, default_labels, default_positive) joined with whatever the
    saved config holds; what is missing gets its default."""
    return stages.join(config, "stage", "left").select(
        "stage",
        F.coalesce("labels", "default_labels").alias("labels"),
        F.coalesce("positive_label", "default_positive").alias("positive_label"),
        F.coalesce("decision_threshold", F.lit(0.5)).alias("decision_threshold"),
    )


# ---- hierarchy ------------------------------------------------------------------

def hierarchical_predict(df: DataFrame, stage1, stage2, threshold1: float = 0.5, threshold2: float = 0.5,
                         labels1: list[str] = SUBJECTIVITY_LABELS, positive1: str = "opinionated",
                         labels2: list[str] = POLARITY_LABELS, positive2: str = "positive") -> DataFrame:
    """Two-stage labels. stage1/stage2 take a frame and return it with a map
    column `scores`; stage 2 is only given the opinionated rows. What stage 1 gives
    is kept in the shared folder, so that it sees each row once."""
    label1, score1 = binary_label_and_score("scores", positive1, labels1, threshold1)
    first = cut_lineage(stage1(df).withColumn("stage1_label", label1).withColumn("stage1_score", score1).drop("scores"))
    neutral = (
        first.where(F.col("stage1_label") != "opinionated")
        .withColumn("stage2_label", F.lit(None).cast("string"))
        .withColumn("stage2_score", F.lit(None).cast("double"))
        .withColumn("final_label", F.col("stage1_label"))
    )
    label2, score2 = binary_label_and_score("scores", positive2, labels2, threshold2)
    scored = (
        stage2(first.where(F.col("stage1_label") == "opinionated"))
        .withColumn("stage2_label", label2).withColumn("stage2_score", score2)
        .withColumn("final_label", F.col("stage2_label")).drop("scores")
    )
    return neutral.unionByName(scored.select(*neutral.columns))


def score_map(labels: list[str], scores: list[Column | str]) -> Column:
    return F.create_map(*[x for l, s in zip(labels, scores) for x in (F.lit(l), as_col(s))])


def fill_neutral_polarity(df: DataFrame) -> DataFrame:
    """Neutral rows get neutral polarity where none is stored."""
    return df.withColumn("polarity_label", F.when(
        (F.col("subjectivity_label") == "neutral") & F.col("polarity_label").isNull(), "neutral",
    ).otherwise(F.col("polarity_label")))


def polarity_pos_neg(scores: Column | str) -> Column:
    """positive iff its score is at least the negative one; other classes are ignored."""
    scores = as_col(scores)
    pos = F.coalesce(F.element_at(scores, "positive"), F.lit(0.0))
    neg = F.coalesce(F.element_at(scores, "negative"), F.lit(0.0))
    return F.when(pos >= neg, "positive").otherwise("negative")


def polarity_pending(df: DataFrame, platform: str | None = None) -> DataFrame:
    return pending_classification(df, "polarity", platform).where(F.col("subjectivity_label") == "opinionated")


def label_distribution(df: DataFrame, platform: str | None = None) -> DataFrame:
    """task, label, n over non-null labels of both tasks, in one pass."""
    if platform not in (None, "all"):
        df = df.where(F.col("platform") == platform)
    pairs = F.array(*[
        F.struct(F.lit(t).alias("task"), F.col(f"{t}_label").alias("label")) for t in ("subjectivity", "polarity")
    ])
    return (
        df.select(F.explode(pairs).alias("p")).select("p.*").where(F.coalesce("label", F.lit("")) != "")
        .groupBy("task", "label").agg(F.count(F.lit(1)).alias("n"))
    )


def sarcasm_prediction(scores: Column | str, threshold: float = 0.5) -> tuple[Column, Column]:
    """(label, score): the stored score is the sarcastic one whatever the label."""
    score = F.element_at(as_col(scores), "sarcastic")
    return F.when(at_least(score, threshold), "sarcastic").otherwise("non-sarcastic"), score


# ---- annotation of record sets ---------------------------------------------------

def annotation_text(cleaned: str = "cleaned_text", text: str = "text") -> Column:
    empty = F.lit("")
    return F.coalesce(F.nullif(utrim(cleaned), empty), utrim(text), empty)


def missing_value(value: Column | str) -> Column:
    return F.coalesce(F.lower(utrim(as_col(value).cast("string"))), F.lit("")).isin("", "nan", "none", "null")


def annotation_candidates(df: DataFrame, targets: list[str], force: bool = False, key: str = "post_id") -> DataFrame:
    """key, text of rows where any target cell is missing (all rows with force)
    and there is text. A column the table lacks counts as missing. Rows labelled
    neutral carry an empty polarity and so come back on every run."""
    need = F.lit(force)
    for c in targets:
        need = need | (missing_value(c) if c in df.columns else F.lit(True))
    out = df.where(need).select(F.coalesce(F.col(key), F.lit("")).alias(key), annotation_text().alias("text"))
    return out.where(F.col("text") != "")


def format_score(value: Column | str) -> Column:
    """Six decimals; '' for null, text that is no number, NaN and infinities."""
    number = as_col(value).try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(math.inf))
    return F.when(finite, F.format_string("%.6f", number)).otherwise("")


def hierarchical_updates(predictions: DataFrame, key: str = "post_id") -> DataFrame:
    """Predictions as the strings that go into the record set."""
    return predictions.select(
        key,
        F.col("stage1_label").alias("subjectivity_label"),
        format_score("stage1_score").alias("subjectivity_score"),
        F.when(F.col("stage2_label").isNotNull(), F.col("final_label")).otherwise("").alias("polarity_label"),
        format_score("stage2_score").alias("polarity_score"),
    )


def merge_annotations(rows: DataFrame, updates: DataFrame, columns: list[str], key: str = "post_id",
                      order: str | None = None) -> DataFrame:
    """rows with `columns` set for the ids in updates; new columns go to the end
    and stay blank elsewhere. Of several updates of an id the last by `order` wins;
    without an order the largest by the updated columns does, so that no row multiplies."""
    updates = first_per_key(updates, [key], [F.desc(c) for c in ([order] if order else columns)])
    new = updates.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_matched"))
    # record sets may repeat an id, blank ones above all
    joined = attach_lookup(rows, new, key, [c for c in new.columns if c != key])
    kept = list(rows.columns)
    added = [c for c in columns if c not in kept]

    def old(c: str) -> Column:
        return F.col(c) if c in kept else F.lit("")

    return joined.select(*[
        F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(old(c)).alias(c) if c in columns else F.col(c)
        for c in kept + added
    ])


RANGES = 1024


def _spread(low, high, kind: T.DataType) -> Column:
    """Where a value lies between low and high, as one of RANGES numbers that ascend
    with the values: low is in the first, high in the last."""
    if isinstance(kind, T.IntegralType):  # differences of whole numbers, exact
        ratio = (F.col("_v").cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")).cast("double") / float(high - low)
    else:
        ratio = (F.col("_v").cast("double") / 2 - low / 2) / (high / 2 - low / 2)
    return F.least(F.floor(ratio * RANGES), F.lit(RANGES - 1))


def p95_nearest_rank(df: DataFrame, value: str, share: float = 0.95) -> DataFrame:
    """sorted(values)[round((n - 1) * share)], half to even; 0 for no rows. Nulls do not
    count; infinities and NaN stand where sorting puts them.

    Exact selection without sorting: the values between the bounds are counted in 1,024
    ranges, and the range that holds the rank gives the next bounds, its least and
    largest value, until they are one. What meets in one place are the counts of the
    ranges, however many distinct values there are; three rounds narrow a billion whole
    numbers down to one. The column is written once, before the first round.
    """
    kind = df.schema[value].dataType
    values = cut_lineage(df.select(F.col(value).alias("_v")).where(F.col("_v").isNotNull()))
    order = F.lit(1)  # finite values; the others are picked by their place
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        inf = F.lit(math.inf)
        order = F.when(F.col("_v") == -inf, 0).when(F.isnan("_v"), 3).when(F.col("_v") == inf, 2).otherwise(1)
    counts = {r[0]: r[1] for r in values.groupBy(order.alias("o")).count().collect()}
    rank = round((sum(counts.values()) - 1) * share)
    for part in sorted(counts):
        if rank < counts[part]:
            break
        rank -= counts[part]
    else:
        part = 1
    rows = values.where(order == part)
    if part == 1 and counts.get(1):
        low, high = rows.agg(F.min("_v"), F.max("_v")).first()
        while low < high:
            inside = rows.where(F.col("_v").between(low, high))
            ranges = inside.groupBy(_spread(low, high, kind).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
            for r in sorted(ranges.collect(), key=lambda r: r.low):  # RANGES rows at most
                if rank < r.n:
                    low, high = r.low, r.high
                    break
                rank -= r.n
        rows = rows.where(F.col("_v") == F.lit(low))
    return rows.agg(F.coalesce(F.min("_v"), F.lit(0)).alias("p95"))


def annotation_stats(records: DataFrame, text: str = "text", batch_size: int = 32,
                     elapsed_seconds: float | None = None) -> DataFrame:
    """Counts, batches and text-length figures of a run; rates where the caller timed it."""
    lengths = records.where(F.length(utrim(text)) > 0).select(F.char_length(text).alias("len"))
    hist = lengths.groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    all_rows = W.partitionBy(F.lit(1))
    total = F.sum("n").over(all_rows)
    ranked = hist.select(
        "len", "n",
        F.sum("n").over(all_rows.orderBy("len").rowsBetween(W.unboundedPreceding, 0)).alias("upto"),
        half_even((total - 1) * 0.95).alias("rank"),
    )
    n = F.coalesce(F.sum("n"), F.lit(0))
    out = ranked.agg(
        n.alias("total_records"),
        F.ceil(n / max(1, batch_size)).cast("bigint").alias("total_batches"),
        F.coalesce(F.sum(F.col("len") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("avg_characters_per_text"),
        F.coalesce(F.max("len"), F.lit(0)).cast("bigint").alias("max_characters_per_text"),
        F.coalesce(F.min(F.when(F.col("upto") > F.col("rank"), F.col("len"))), F.lit(0)).cast("bigint").alias("p95_characters_per_text"),
    )
    if elapsed_seconds is None:
        return out
    t = F.lit(float(elapsed_seconds))
    safe = F.when(t > 0, t)
    return (
        out.withColumn("elapsed_seconds", t)
        .withColumn("records_per_second", F.coalesce(F.col("total_records") / safe, F.lit(0.0)))
        .withColumn("batches_per_second", F.coalesce(F.col("total_batches") / safe, F.lit(0.0)))
        .withColumn("avg_seconds_per_batch", F.coalesce(t / F.nullif(F.col("total_batches"), F.lit(0)), F.lit(0.0)))
    )

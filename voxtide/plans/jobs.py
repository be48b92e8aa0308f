"""Whole runs composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.functions import vocab
from voxtide.functions.text import exact_hash
from voxtide.operators import cleaning, ingest, labels, relevance, rules, sentiment, state
from voxtide.operators.language import Detector
from voxtide.schema import CLEAN_STATUSES, POLARITY_LABELS, SUBJECTIVITY_LABELS
from voxtide.session import cut_lineage


def ingest_run(existing: DataFrame, raw: DataFrame, detector: Detector, cap: int = vocab.DEFAULT_CAP) -> DataFrame:
    """Landed hits to the stored table: filter, cap per query, first-wins append."""
    posts = ingest.normalize_posts(raw)
    accepted = rules.rule_filter(posts, detector)
    capped = ingest.cap_per_key(accepted, "query", cap)
    return ingest.upsert_ignore(existing, capped.drop("lang", "reply_count"))


def clean_run(table: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(updated table, summary of this run)"""
    table = state.reset_columns(table, "clean") if force else table
    done = cleaning.clean_rows(state.pending_clean(table))
    updates = done.select("post_id", "cleaned_text", "clean_status")
    return (state.apply_updates(table, updates, ["cleaned_text", "clean_status"]),
            cleaning.clean_summary(done, CLEAN_STATUSES))


def sentiment_run(table: DataFrame, lexicon: DataFrame, force: bool = False) -> DataFrame:
    table = state.reset_columns(table, "sentiment") if force else table
    scores = sentiment.lexicon_sentiment(state.pending_sentiment(table), lexicon, ["post_id"])
    scores = scores.withColumn("sentiment_label", sentiment.sentiment_label("sentiment_score"))
    return state.apply_updates(table, scores, ["sentiment_score", "sentiment_label"])


def relevance_run(table: DataFrame, force: bool = False) -> DataFrame:
    table = state.reset_columns(table, "relevance") if force else table
    found = relevance.relevance_labels(state.pending_relevance(table), ["post_id"], relevance.scoring_text())
    return state.apply_updates(table, found, ["relevance_score", "relevance_label"])


def classify_run(table: DataFrame, platform: str = "all", force: bool = False) -> DataFrame:
    """Subjectivity for pending rows, neutral polarity for neutral rows, then
    positive or negative for the opinionated rest."""
    if force:
        table = state.reset_columns(state.reset_columns(table, "subjectivity"), "polarity")
    pending = state.pending_classification(table, "subjectivity", platform)
    sub = relevance.candidate_scores(pending, vocab.SUBJECTIVITY_TERMS, ["post_id"], relevance.scoring_text()).select(
        "post_id", relevance.top_label(SUBJECTIVITY_LABELS).alias("subjectivity_label"))
    table = state.apply_updates(table, sub, ["subjectivity_label"])
    scope = F.lit(True) if platform == "all" else F.col("platform") == platform
    table = table.withColumn("polarity_label", F.when(
        scope & (F.col("subjectivity_label") == "neutral") & F.col("polarity_label").isNull(), "neutral",
    ).otherwise(F.col("polarity_label")))
    waiting = labels.polarity_pending(table, platform)
    votes = relevance.candidate_scores(waiting, vocab.POLARITY_TERMS, ["post_id"], relevance.scoring_text())
    pol = votes.select("post_id", labels.polarity_pos_neg(
        labels.score_map(POLARITY_LABELS, [F.get("scores", F.lit(0)), F.get("scores", F.lit(1))])).alias("polarity_label"))
    return state.apply_updates(table, pol, ["polarity_label"])


def untrained_two_stage(rows: DataFrame) -> DataFrame:
    """gold, predicted for rows (post_id, text, label_name): label scoring only."""
    sub = relevance.candidate_scores(rows, vocab.SUBJECTIVITY_TERMS, ["post_id", "label_name"], "text").select(
        "post_id", "label_name", relevance.top_label(SUBJECTIVITY_LABELS).alias("stage1"))
    neutral = sub.where(F.col("stage1") == "neutral").select(
        "post_id", F.col("label_name").alias("gold"), F.lit("neutral").alias("predicted"))
    opinionated = rows.join(sub.where(F.col("stage1") == "opinionated").select("post_id"), "post_id", "left_semi")
    pol = relevance.candidate_scores(opinionated, vocab.POLARITY_TERMS, ["post_id", "label_name"], "text").select(
        "post_id", F.col("label_name").alias("gold"), relevance.top_label(POLARITY_LABELS).alias("predicted"))
    return neutral.unionByName(pol)


def opinion_report(posts: DataFrame, lexicon: DataFrame, detector: Detector) -> DataFrame:
    """Accepted, non-duplicate posts: rows, sentiment counts and mean score per platform.

    The texts are read twice, once to judge and once to score, and neither pass
    shuffles them: what is decided across rows is decided on ids and hashes,
    kept in the shared folder between the steps.
    """
    order = "ingest_seq"
    narrow = rules.judge(posts, detector).withColumn("_exact", exact_hash("text")).select(order, "platform", "_exact", *rules.JUDGED)
    accepted = rules.settle(cut_lineage(narrow), order).where(F.col("reason").isNull()).select(order, "platform", "_exact")
    unique = cleaning.repeated(cut_lineage(accepted), "_exact", order).where(~F.col("is_duplicate"))
    scores = sentiment.lexicon_sentiment(posts, lexicon, [order])
    label = sentiment.sentiment_label("sentiment_score")
    return unique.select(order, "platform").join(scores, order).groupBy("platform").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(label == l).alias(l) for l in ("positive", "negative", "neutral")],
        F.round(F.avg("sentiment_score"), 4).alias("avg_score"),
    )


def _map_scorer(terms: dict[str, dict[str, int]]):
    """A stage that scores candidate labels and gives them as a map."""
    def score(df: DataFrame) -> DataFrame:
        scored = relevance.candidate_scores(df, terms, df.columns, "text")
        names = list(terms)
        return scored.withColumn("scores", labels.score_map(names, [F.get("scores", F.lit(i)) for i in range(len(names))])).drop("votes")
    return score


def annotate_hierarchical_run(records: DataFrame, targets: list[str], force: bool = False, key: str = "post_id") -> tuple[DataFrame, DataFrame]:
    """(records with labels and scores filled in, statistics of the run): rows that
    lack one of the targets are scored for subjectivity, the opinionated ones for
    polarity. `key` is unique among the rows that are scored."""
    todo = cut_lineage(labels.annotation_candidates(records, targets, force, key))
    found = labels.hierarchical_predict(todo, _map_scorer(vocab.SUBJECTIVITY_TERMS), _map_scorer(vocab.POLARITY_TERMS))
    updates = labels.hierarchical_updates(found, key)
    columns = [c for c in updates.columns if c != key]
    return labels.merge_annotations(records, updates, columns, key), labels.annotation_stats(todo)


def annotate_sarcasm_run(records: DataFrame, target: str, force: bool = False, key: str = "post_id") -> tuple[DataFrame, DataFrame]:
    """(records with target and sarcasm_score filled in, statistics of the run)."""
    todo = cut_lineage(labels.annotation_candidates(records, [target], force, key))
    scored = _map_scorer(vocab.SARCASM_TERMS)(todo)
    label, score = labels.sarcasm_prediction(F.col("scores"))
    updates = scored.select(key, label.alias(target), labels.format_score(score).alias("sarcasm_score"))
    return labels.merge_annotations(records, updates, [target, "sarcasm_score"], key), labels.annotation_stats(todo)

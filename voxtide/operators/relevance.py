"""Candidate-label scoring and relevance labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.functions import vocab
from voxtide.functions.text import as_col, blank_or, tokens
from voxtide.operators.votes import argmax, softmax, table_votes, token_votes, votes_array
from voxtide.schema import RELEVANCE_LABELS


def scoring_text(cleaned: str = "cleaned_text", text: str = "text") -> Column:
    """cleaned text where there is any, else the raw text"""
    return blank_or(cleaned, text)


def candidate_scores(df: DataFrame, weights: dict[str, dict[str, int]] | DataFrame, keys: list[str], text: Column | str) -> DataFrame:
    """keys plus `votes` (whole numbers) and `scores` (softmax), both in candidate order.

    Texts without a known term get the same score for every label. Weights are a
    vocabulary per label, or a table (term, v0, v1, ..) of any size.
    """
    words = tokens(F.lower(as_col(text)))
    if isinstance(weights, DataFrame):
        votes = table_votes(df, words, keys, weights)
        votes = votes.select(*keys, votes_array(len(votes.columns) - len(keys)).alias("votes"))
    else:
        votes = token_votes(df, words, keys, weights)
    return votes.select(*keys, "votes", softmax(F.transform("votes", lambda v: v / 1000.0)).alias("scores"))


def top_label(labels: list[str]) -> Column:
    """Best label of `votes`; ties go to the earlier candidate."""
    return F.element_at(F.array(*[F.lit(l) for l in labels]), argmax(F.col("votes")) + 1)


def top_score() -> Column:
    return F.array_max("scores")


def relevance_labels(df: DataFrame, keys: list[str], text: Column | str,
                     weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """keys, relevance_score, relevance_label: top candidate through the label map, no threshold."""
    weights = weights or vocab.RELEVANCE_TERMS
    named = [vocab.RELEVANCE_CANDIDATES[c] for c in weights]
    return candidate_scores(df, weights, keys, text).select(
        *keys, top_score().alias("relevance_score"), top_label(named).alias("relevance_label"))


def relevance_from_scores(labels: Column, scores: Column) -> tuple[Column, Column]:
    """(score, label) from a scorer's descending label and score lists."""
    mapping = F.create_map(*[F.lit(x) for kv in vocab.RELEVANCE_CANDIDATES.items() for x in kv])
    return F.get(scores, F.lit(0)), F.element_at(mapping, F.get(labels, F.lit(0)))


def relevance_summary(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col("relevance_label") == l).alias(l) for l in RELEVANCE_LABELS])


def relevant_only(df: DataFrame) -> DataFrame:
    """Unlabelled rows stay."""
    return df.where(F.col("relevance_label").isNull() | (F.col("relevance_label") == "relevant"))

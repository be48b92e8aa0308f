"""Lexicon sentiment of the raw text, and the report built on it.

Rule constants follow Hutto & Gilbert (2014); the vocabulary is a table and can
be replaced. A row's valences are summed in whole millionths.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtide.functions import vocab
from voxtide.functions.text import as_col, tokens
from voxtide.operators.skew import top_n_per_key
from voxtide.operators.votes import literal_map, looked_up, numbered


def lexicon_table(spark: SparkSession, lexicon: dict[str, float] | None = None) -> DataFrame:
    rows = sorted((lexicon or vocab.SENTIMENT_LEXICON).items())
    return spark.createDataFrame(rows, "term string, valence double")


def _booster(token: Column) -> Column:
    """What a lower-cased word adds to the valence after it."""
    return (
        F.when(token.isin(vocab.BOOST_WORDS), F.lit(vocab.BOOST))
        .when(token.isin(vocab.DAMPEN_WORDS), F.lit(-vocab.BOOST))
        .otherwise(F.lit(0.0))
    )


def _char_count(char: str) -> Column:
    return F.length("_text") - F.length(F.replace(F.col("_text"), F.lit(char)))


def _shouted(token: Column) -> Column:
    return (F.upper(token) == token) & (F.lower(token) != token)


MAX_TERMS = 50_000


def lexicon_sentiment(df: DataFrame, lexicon: DataFrame, keys: list[str], text: str = "text", max_terms: int = MAX_TERMS) -> DataFrame:
    """keys plus sentiment_score in [-1, 1]; rows without a known word score 0. Of a
    term given twice the higher valence counts.

    A lexicon of at most max_terms words becomes part of the plan, and a row is scored
    where it lies: the places of lexicon words are picked by a hash-set test, and each
    is valued with the three words before it, without a shuffle. The words of a larger
    one are found by a join with the distinct words of blocks of rows. Rows that share a
    key stay rows of their own.
    """
    lexicon = lexicon.groupBy("term").agg(F.max(F.col("valence").cast("double")).alias("valence")).where("term is not null and valence is not null")
    rows = lexicon.limit(max_terms + 1).collect()
    values = {r["term"]: r["valence"] for r in rows} if len(rows) <= max_terms else None
    plain = F.replace(F.col(text), F.lit("’"), F.lit("'"))
    prepared = df.select(
        *keys, F.col(text).alias("_text"), F.coalesce(tokens(plain, "'"), F.array().cast("array<string>")).alias("_toks"),
    ).select(*keys, "_text", "_toks", F.transform("_toks", F.lower).alias("_low"))
    # a shouted word only counts where the text is not shouted as a whole
    marks = [
        F.col("_text").rlike("\\p{Ll}").alias("_mixed_case"),
        F.coalesce(F.array_position("_low", "but"), F.lit(0)).alias("_but"),
        F.least(_char_count("!"), F.lit(vocab.MAX_EXCLAIM)).alias("_bangs"),
        _char_count("?").alias("_asks"),
    ]
    if values is None:
        rows = numbered(prepared.select(*keys, "_low", F.zip_with("_toks", "_low", lambda t, low: (low != t) & (F.upper(t) == t)).alias("_caps"), *marks))
        out = T.StructType([*rows.select(*keys).schema.fields, *[T.StructField(n, T.LongType()) for n in ("_total", "_bangs", "_asks")]])
        found = looked_up(rows, "_low", lexicon, ["valence"], out, _block_scores(keys))
        return found.select(*keys, compound(F.col("_total"), F.coalesce("_bangs", F.lit(0)), F.coalesce("_asks", F.lit(0))).alias("sentiment_score"))
    found = F.array().cast("array<struct<i: int, v: double>>")
    if values:
        valence = literal_map(values)
        place = F.filter(F.transform("_low", lambda t, i: F.when(t.isin(list(values)), i)), lambda i: i.isNotNull())
        found = F.transform(place, lambda i: F.struct(i.alias("i"), F.element_at(valence, F.get("_low", i)).alias("v")))
    prepared = prepared.select(*keys, "_toks", "_low", found.alias("_found"), *marks)
    factors = F.array(*[F.lit(round(vocab.NEGATE ** k, 6)) for k in range(4)])

    def micro(i: Column, v: Column) -> Column:
        """What the word at a place adds, from its valence, in whole millionths."""
        before = [F.coalesce(F.get("_low", i - k), F.lit("")) for k in (1, 2, 3)]
        word = F.get("_toks", i)
        shouted = F.when(F.col("_mixed_case") & _shouted(word), vocab.CAPS).otherwise(0.0)
        push = sum((_booster(b) * F.lit(d) for b, d in zip(before, vocab.BOOST_DECAY)), F.lit(0.0))
        negators = sum((F.when(b.isin(vocab.NEGATIONS), 1).otherwise(0) for b in before), F.lit(0))
        signed = (v + F.signum(v) * (shouted + push)) * F.element_at(factors, negators + 1)
        side = (
            F.when((F.col("_but") > 0) & (i + 1 < F.col("_but")), vocab.BUT_BEFORE)
            .when((F.col("_but") > 0) & (i + 1 > F.col("_but")), vocab.BUT_AFTER)
            .otherwise(1.0)
        )
        return F.round(signed * side * 1e6, 0).cast("bigint")

    total = F.aggregate("_found", F.lit(0).cast("bigint"), lambda acc, x: acc + micro(x["i"], x["v"]))
    return prepared.select(*keys, compound(total, F.coalesce("_bangs", F.lit(0)), F.coalesce("_asks", F.lit(0))).alias("sentiment_score"))


def _block_scores(keys: list[str]) -> Callable[[pa.Table, np.ndarray, np.ndarray, pa.Table], pa.Table]:
    """lexicon_sentiment's sums for a block of rows: the same steps in the same order on
    the block's words, so the sums are equal to the last digit."""
    boosts, dampens, negations = (pa.array(list(x), pa.string()) for x in (vocab.BOOST_WORDS, vocab.DAMPEN_WORDS, vocab.NEGATIONS))
    boost, decay, caps, but_before, but_after = vocab.BOOST, vocab.BOOST_DECAY, vocab.CAPS, vocab.BUT_BEFORE, vocab.BUT_AFTER
    factors = np.array([round(vocab.NEGATE ** k, 6) for k in range(4)])

    def total(block: pa.Table, row: np.ndarray, places: np.ndarray, found: pa.Table) -> pa.Table:
        listed = block.column("_low").combine_chunks()
        n = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
        words = pc.list_flatten(listed)
        is_in = lambda given: pc.is_in(words, value_set=given).to_numpy(zero_copy_only=False)
        pushes = np.where(is_in(boosts), boost, np.where(is_in(dampens), -boost, 0.0))
        negates = is_in(negations)
        i = places - (np.cumsum(n) - n)[row]
        v = found.column("valence").to_numpy()
        push, negators = np.zeros(len(i)), np.zeros(len(i), np.int64)
        for k, d in zip((1, 2, 3), decay):
            there = i >= k
            at = np.where(there, places - k, 0)
            push = push + np.where(there, pushes[at], 0.0) * d
            negators = negators + (there & negates[at])
        mixed = pc.fill_null(block.column("_mixed_case"), False).to_numpy()[row]
        shouted = pc.list_flatten(block.column("_caps").combine_chunks()).to_numpy(zero_copy_only=False)[places]
        signed = (v + np.sign(v) * (np.where(mixed & shouted, caps, 0.0) + push)) * factors[negators]
        but = block.column("_but").to_numpy()[row]
        micro = signed * np.where((but > 0) & (i + 1 < but), but_before, np.where((but > 0) & (i + 1 > but), but_after, 1.0)) * 1e6
        whole = np.trunc(np.abs(micro))
        sums = np.zeros(block.num_rows, np.int64)
        np.add.at(sums, row, (np.sign(micro) * (whole + (np.abs(micro) - whole >= 0.5))).astype(np.int64))
        out = block.select(keys).append_column("_total", pa.array(sums))
        return out.append_column("_bangs", block.column("_bangs").cast(pa.int64())).append_column("_asks", block.column("_asks").cast(pa.int64()))

    return total


def compound(micro: Column, bangs: Column, asks: Column) -> Column:
    """Summed valence (in millionths) and punctuation to a score in [-1, 1]."""
    emphasis = bangs * vocab.EXCLAIM + (
        F.when(asks <= 1, F.lit(0.0)).when(asks <= 3, asks * vocab.QUESTION).otherwise(F.lit(vocab.QUESTION_MANY))
    )
    total = micro / 1e6 + F.signum(micro.cast("double")) * emphasis
    return F.round(total / F.sqrt(total * total + vocab.NORM_ALPHA), 4)


def sentiment_label(score: Column | str) -> Column:
    score = as_col(score)
    return F.when(score >= 0.05, "positive").when(score <= -0.05, "negative").when(score.isNotNull(), "neutral")


def _n_label(label: str) -> Column:
    return F.count_if(F.col("sentiment_score").isNotNull() & (F.col("sentiment_label") == label)).alias(label)


def summarize(df: DataFrame) -> DataFrame:
    """total, positive, negative, neutral, avg_score over rows that have a score."""
    return df.agg(
        F.count("sentiment_score").alias("total"),
        _n_label("positive"), _n_label("negative"), _n_label("neutral"),
        F.coalesce(F.round(F.avg("sentiment_score"), 4), F.lit(0.0)).alias("avg_score"),
    )


def percentages(summary: DataFrame) -> DataFrame:
    total = F.greatest(F.col("total"), F.lit(1))
    return summary.select(*[
        F.round(F.col(c) / total * 100, 1).alias(f"{c}_pct") for c in ("positive", "negative", "neutral")
    ])


def platform_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("platform").agg(F.count(F.lit(1)).alias("n")).orderBy("platform")


def samples(df: DataFrame, n: int = 3, width: int = 100, order: str = "ingest_seq") -> DataFrame:
    """The first n positive and negative rows, text cut for display."""
    picked = top_n_per_key(df.where(F.col("sentiment_label").isin("positive", "negative")),
                           "sentiment_label", n, [F.col(order)], order)
    return picked.select("sentiment_label", "platform", "author", F.substring("text", 1, width).alias("sample"))

"""Rule filter: which posts are dropped at ingest, and why.

Rules 1-5 look at one row and compile into a single CASE. Rule 6 (near
duplicates) depends on arrival order; "differs from an earlier accepted text
with the same fuzzy hash" has a closed form: among the rows that pass rules
1-5, the first text of a hash is always accepted and every accepted text of
that hash equals it, so a row is rejected iff its text differs from the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.functions import vocab
from voxtide.functions.text import NOT_WS, WORD, as_col, contains_any, fuzzy_hash, pattern_count, utrim, where_has
from voxtide.operators.language import Detector
from voxtide.operators.skew import attach_stats
from voxtide.session import cut_lineage

URL = f"https?://{NOT_WS}+"
HASHTAG = f"#{WORD}+"


def too_short(text: Column | str) -> Column:
    return F.char_length(utrim(text)) < vocab.MIN_TEXT_LENGTH


def english(lang: Column | str, detected: Column | str) -> Column:
    """A hint decides alone (an empty one is not English); without a hint the
    detected language decides, and an undetectable text is accepted."""
    lang = as_col(lang)
    fallback = F.coalesce(as_col(detected) == "en", F.lit(True))
    return F.when(lang.isNotNull(), lang.startswith("en")).otherwise(fallback)


def url_count(text: Column | str) -> Column:
    return where_has(as_col(text), "http", pattern_count(text, URL), F.lit(0))


def hashtag_count(text: Column | str) -> Column:
    return where_has(as_col(text), "#", pattern_count(text, HASHTAG), F.lit(0))


def blocklisted(text: Column | str, phrases: list[str] | None = None) -> Column:
    """An empty list means the default one."""
    return contains_any(F.lower(as_col(text)), [p.lower() for p in (phrases or vocab.BLOCKLIST)])


def row_reason(detected: Column | str, text: str = "text", lang: str = "lang", phrases: list[str] | None = None) -> Column:
    """First failing rule among those that look at one row only."""
    return (
        F.when(too_short(text), "min_text_length")
        .when(~english(lang, detected), "language")
        .when(url_count(text) > vocab.MAX_URLS, "url_density")
        .when(hashtag_count(text) > vocab.MAX_HASHTAGS, "hashtag_density")
        .when(blocklisted(text, phrases), "keyword_blocklist")
    )


JUDGED = ["_row_reason", "_hash", "_d1", "_d2"]


def with_row_reason(df: DataFrame, detector: Detector, text: str = "text", lang: str = "lang",
                    phrases: list[str] | None = None) -> DataFrame:
    """df plus `_row_reason`, found where the text lies; rows without a hint are detected."""
    tagged = df.withColumn("_detected", detector.without_hint(text, lang))
    return tagged.withColumn("_row_reason", row_reason("_detected", text, lang, phrases)).drop("_detected")


def judge(df: DataFrame, detector: Detector, text: str = "text", lang: str = "lang",
          session: str | None = None, phrases: list[str] | None = None) -> DataFrame:
    """df plus what the order-dependent rule needs to know of a row; with these
    columns the text itself is no longer needed. No shuffle."""
    scope = F.col(session).cast("string") if session else F.lit("all")
    return (
        with_row_reason(df, detector, text, lang, phrases)
        .withColumn("_hash", F.when(F.col("_row_reason").isNull(), F.concat_ws(":", scope, fuzzy_hash(text))))
        .withColumn("_d1", F.xxhash64(text))
        .withColumn("_d2", F.xxhash64(F.lit(1), F.col(text)))
    )


def settle(judged: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Judged rows with `reason` in place of the helper columns."""
    # Two 64-bit digests stand for the first text: long buffers keep this a hash
    # aggregate with map-side combine.
    firsts = cut_lineage(
        judged.where(F.col("_row_reason").isNull())
        .groupBy("_hash")
        .agg(
            F.min_by("_d1", order).alias("_f1"),
            F.min_by("_d2", order).alias("_f2"),
            F.count(F.lit(1)).alias("_n"),
        )
        .where(F.col("_n") > 1)
    )
    out = attach_stats(judged, firsts, ["_hash"], ["_f1", "_f2"], "_n", F.col(order))
    differs = (F.col("_f1") != F.col("_d1")) | (F.col("_f2") != F.col("_d2"))
    reason = F.coalesce(F.col("_row_reason"), F.when(differs, "near_duplicate"))
    return out.select(*[c for c in judged.columns if c not in JUDGED], reason.alias("reason"))


def near_duplicates(df: DataFrame, detector: Detector, order: str = "ingest_seq", **kwargs) -> DataFrame:
    """order of the rows that only the order-dependent rule rejects."""
    return cut_lineage(verdicts(df, detector, order, **kwargs).where(F.col("reason") == "near_duplicate").select(order))


def rejection_reasons(df: DataFrame, detector: Detector, text: str = "text", lang: str = "lang", order: str = "ingest_seq",
                      session: str | None = None, phrases: list[str] | None = None) -> DataFrame:
    """df plus `reason`: the first failing rule, or null for accepted rows.

    `session` names a column that scopes the duplicate memory; without one all
    rows share it. `order` must be unique.

    Rules on one row are judged where the row lies. The cross-row rule is settled
    on ids and digests kept in the shared folder; only the ids it rejects are
    joined back. A caller that drops the text shuffles none.
    """
    repeats = near_duplicates(df, detector, order, text=text, lang=lang, session=session, phrases=phrases)
    flagged = repeats.select(F.col(order).alias("_o"), F.lit(True).alias("_repeat"))
    tagged = with_row_reason(df, detector, text, lang, phrases)
    joined = tagged.join(flagged, F.col(order) == F.col("_o"), "left")
    return joined.select(*df.columns, F.coalesce("_row_reason", F.when(F.col("_repeat"), "near_duplicate")).alias("reason"))


def verdicts(df: DataFrame, detector: Detector, order: str = "ingest_seq", **kwargs) -> DataFrame:
    """order, reason for every row of df."""
    return settle(cut_lineage(judge(df, detector, **kwargs).select(order, *JUDGED)), order)


def rule_filter(df: DataFrame, detector: Detector, text: str = "text", lang: str = "lang", order: str = "ingest_seq",
                session: str | None = None, phrases: list[str] | None = None) -> DataFrame:
    """Accepted rows only. Rows that fail by themselves are dropped where they lie;
    the rest meets the ids of rejected near duplicates in an anti-join."""
    repeats = near_duplicates(df, detector, order, text=text, lang=lang, session=session, phrases=phrases)
    passed = with_row_reason(df, detector, text, lang, phrases).where(F.col("_row_reason").isNull()).select(*df.columns)
    return passed.join(repeats, order, "left_anti").select(*df.columns)


def rejection_summary(df: DataFrame, detector: Detector, order: str = "ingest_seq", **kwargs) -> DataFrame:
    """Rows per reason; the texts never travel."""
    return (
        verdicts(df, detector, order, **kwargs)
        .groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )

"""Row types and label domains."""

from __future__ import annotations

from pyspark.sql import types as T

# Label domains; the position in a list is the label index.
SENTIMENT_LABELS = ["positive", "negative", "neutral"]
RELEVANCE_LABELS = ["relevant", "spam", "off_topic"]
CLEAN_STATUSES = ["cleaned", "too_short", "bot", "duplicate"]
SUBJECTIVITY_LABELS = ["neutral", "opinionated"]
POLARITY_LABELS = ["negative", "positive"]
FINAL_LABELS = ["neutral", "negative", "positive"]
SARCASM_LABELS = ["non-sarcastic", "sarcastic"]


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(*f) for f in fields])


_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()

OPINION = _schema(
    ("ingest_seq", _L, True),
    ("platform", _S, True),
    ("post_id", _S, True),
    ("author", _S, True),
    ("text", _S, True),
    ("created_at", _TS, True),
    ("query", _S, True),
    ("likes", _L, True),
    ("reposts", _L, True),
    ("is_reply", _B, True),
    ("parent_post_id", _S, True),
    ("sentiment_score", _D, True),
    ("sentiment_label", _S, True),
    ("relevance_score", _D, True),
    ("relevance_label", _S, True),
    ("cleaned_text", _S, True),
    ("clean_status", _S, True),
    ("subjectivity_label", _S, True),
    ("polarity_label", _S, True),
)

# Columns written at ingest; labels of incoming rows are ignored.
INGEST_COLUMNS = [
    "ingest_seq", "platform", "post_id", "author", "text", "created_at",
    "query", "likes", "reposts", "is_reply", "parent_post_id",
]

# Export column order.
EXPORT_COLUMNS = [
    "platform", "post_id", "author", "text", "created_at", "query", "likes",
    "reposts", "sentiment_score", "sentiment_label", "is_reply",
    "parent_post_id", "relevance_score", "relevance_label", "cleaned_text",
    "clean_status", "subjectivity_label", "polarity_label",
]

RAW_POST = _schema(
    ("uri", _S, True),
    ("author", _schema(("handle", _S, True)), True),
    ("record", _schema(("text", _S, True), ("created_at", _S, True), ("langs", T.ArrayType(_S), True)), True),
    ("like_count", _L, True),
    ("repost_count", _L, True),
    ("reply_count", _L, True),
)

COMMENT = _schema(
    ("subreddit", _S, True),
    ("parent_title", _S, True),
    ("text", _S, True),
    ("score", _S, True),
    ("type", _S, True),
)

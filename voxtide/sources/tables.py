"""The given tables seen as this engine's inputs.

Every expression below is plain SQL that Spark and DuckDB read alike, so the
query side and the checking side start from the same rows. All rows and whole
texts are kept; cases that the prose lacks (links, hashtags, markup, bot and
blocklist phrases, shouting, near copies) are *added* around the whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxtide.functions.vocab import PRESET_QUERIES, DEFAULT_QUERY

_QUERY = (
    "case doc_id % 20 "
    + " ".join(f"when {i} then '{q}'" for i, q in enumerate(PRESET_QUERIES))
    + f" else '{DEFAULT_QUERY}' end"
)

_TEXT = """case doc_id % 20
  when 2 then text || ' https://a.example/1 https://a.example/2 https://a.example/3 https://a.example/4'
  when 3 then text || ' #a #b #c #d #e #f'
  when 4 then text || ' Buy now, limited offer'
  when 5 then '<p>' || text || '</p> I can' || chr(39) || 't stop <b>loving</b> it &amp; 15 tools 😀'
  when 6 then 'I am a bot. This action was performed automatically. ' || text
  when 7 then 'I love these tools, they are great and not bad at all! ' || text
  when 8 then 'Terrible, useless and a COMPLETE waste of time. ' || text
  when 9 then text || '!'
  when 10 then '  ' || text || ' '
  when 11 then text || ' https://a.example/x #ai # tools, it' || chr(39) || 's the women' || chr(39) || 's best stories but very slow??'
  when 12 then '<a href="https://a.example/?a=1&amp;b=2" title="x > y">' || text || '</a> &lbrace; <img alt=' || chr(39) || '1 > 0' || chr(39) || ' src=i.png> &hellip;'
  when 13 then '🇩🇪🇪🇸 ⏰ 👩‍💻 ' || text || ' 👍🏽👍 ❤️ 1️⃣ 🏃🏿‍♂️ 👩🏾‍🚀 🏴󠁧󠁢󠁳󠁣󠁴󠁿 🇩 ™'
  else text end"""

OPINIONS = {
    "ingest_seq": "doc_id",
    "platform": "case when doc_id % 3 = 0 then 'reddit' else 'bluesky' end",
    "post_id": "'doc_' || cast(doc_id as string)",
    "author": "source || case when doc_id % 17 = 0 then 'bot' else '' end || '.example'",
    "text": _TEXT,
    "lang": "case when doc_id % 13 = 0 then cast(null as string) else lang end",
    "created_at": "timestamp '2024-01-01 00:00:00' + doc_id * interval '1' hour",
    "query": _QUERY,
    "likes": "(doc_id * 7919) % 1000",
    "reposts": "(doc_id * 104729) % 100",
    "is_reply": "doc_id % 7 = 0",
    "parent_post_id": "case when doc_id % 7 = 0 then 'doc_' || cast(doc_id - 1 as string) end",
}

# The post table after earlier runs: some rows labelled, some not.
_SENT = "round(((doc_id * 37) % 201 - 100) / 100.0, 2)"
STORED = {
    **{k: v for k, v in OPINIONS.items() if k != "lang"},
    "sentiment_score": f"case when doc_id % 4 <> 0 then cast({_SENT} as double) end",
    "sentiment_label": f"case when doc_id % 4 = 0 then null when {_SENT} >= 0.05 then 'positive' "
                       f"when {_SENT} <= -0.05 then 'negative' else 'neutral' end",
    "relevance_score": "case when doc_id % 5 <> 0 then cast(((doc_id * 53) % 100) / 100.0 as double) end",
    "relevance_label": "case doc_id % 5 when 1 then 'relevant' when 2 then 'relevant' when 3 then 'spam' when 4 then 'off_topic' end",
    "cleaned_text": "case doc_id % 6 when 0 then null when 1 then '' else lower(text) end",
    "clean_status": "case doc_id % 9 when 0 then null when 1 then 'bot' when 2 then 'too_short' when 3 then 'duplicate' else 'cleaned' end",
    "subjectivity_label": "case doc_id % 4 when 0 then null when 1 then 'neutral' else 'opinionated' end",
    "polarity_label": "case doc_id % 8 when 2 then 'positive' when 3 then 'negative' when 5 then 'neutral' end",
}

# Manually labelled rows, all strings.
LABELLED = {
    "post_id": "'doc_' || cast(doc_id as string)",
    "text": "case when doc_id % 31 = 0 then ' ' when doc_id % 37 = 0 then null else text end",
    "cleaned_text": "case when doc_id % 31 = 0 then '' else lower(text) end",
    "subjectivity_detection": "case when doc_id % 29 = 0 then '' when doc_id % 43 = 0 then 'unsure' "
                              "when quality = 1 then ' opinionated' else 'neutral' end",
    "polarity_detection": "case when doc_id % 23 = 0 then '' when toxic = 1 then 'negative' "
                          "when doc_id % 2 = 0 and quality = 1 then 'positive ' else 'neutral' end",
    "sarcasm_detection": "case when doc_id % 19 = 0 then null when (doc_id * 31) % 11 < 3 then 'Sarcastic' else 'non-sarcastic' end",
}

EDGES = {
    "post_id": "cast(conv_id as string) || '-' || cast(turn as string)",
    "parent_post_id": "case when turn > 0 then cast(conv_id as string) || '-' || cast(case when conv_id % 2 = 0 then turn - 1 "
                      "else (turn - 1) - (turn - 1) % 2 end as string) end",
    "node_type": "case when (conv_id + turn) % 11 = 0 then 'blockedPost' else 'threadViewPost' end",
    "text": "case when (conv_id * 3 + turn) % 7 = 1 then 'I agree, AI tools have been very useful' || repeat('!', cast((conv_id + turn) % 3 as int)) "
            "when (conv_id + turn) % 23 = 5 then text || ' https://a.example/1 https://a.example/2 https://a.example/3 https://a.example/4' "
            "when (conv_id + turn) % 29 = 5 then text || ' #a #b #c #d #e #f' when (conv_id + turn) % 31 = 5 then text || ' Buy now, limited offer' else text end",
    "lang": "case when (conv_id + turn) % 13 = 6 then 'fr' when (conv_id + turn) % 5 > 0 then 'en' end",
    "ingest_seq": "conv_id * 1000 + turn",
}

COMMENTS = {
    "subreddit": "role",
    "parent_title": "case when conv_id % 9 = 0 then null else 'conv ' || cast(conv_id as string) end",
    "text": "case when (conv_id + turn) % 10 = 3 then text || ' <img src=x> see www.a.example/1 or http://b.example ![pic](http://c.example/p.png)' "
            "when (conv_id + turn) % 10 = 4 then 'I am a bot, and this action was performed automatically. ' || text else text end",
    "score": "case turn % 5 when 0 then '1.2k' when 1 then '15 points' when 2 then 'score hidden' when 3 then '-3 points' end",
    "type": "'comment'",
    "ingest_seq": "conv_id * 1000 + turn",
}


def _select(spec: dict[str, str]) -> list[str]:
    return [f"{expr} as {name}" for name, expr in spec.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text table, as it lies."""
    return table(spark, sf_dir, "documents")


def opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).selectExpr(*_select(OPINIONS))


def stored_of(docs: DataFrame) -> DataFrame:
    """Stored posts as made of rows of the text table, one of each."""
    return docs.selectExpr(*_select(STORED))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_of(documents(spark, sf_dir))


def _documents_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_with_labels(spark, sf_dir).selectExpr(*_select(LABELLED))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*_select(EDGES))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(*_select(COMMENTS))


def _cte(spec: dict[str, str], source: str) -> str:
    return f"select {', '.join(_select(spec))} from {source}"


# The same inputs as DuckDB common table expressions.
CTES = {
    "opinions": _cte(OPINIONS, "documents"),
    "stored": _cte(STORED, "documents"),
    "labelled": _cte(LABELLED, "labels join documents using (doc_id)"),
    "edges": _cte(EDGES, "conversations"),
    "comments": _cte(COMMENTS, "conversations"),
}

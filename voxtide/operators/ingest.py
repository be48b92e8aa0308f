"""Landed records to post rows, caps, reply threads, first-wins ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.functions import vocab
from voxtide.functions.text import as_col
from voxtide.operators.skew import HOT_KEYS, first_per_key, top_n_per_key
from voxtide.operators.votes import small_table
from voxtide.schema import INGEST_COLUMNS
from voxtide.session import cut_lineage


def post_id(uri: Column | str) -> Column:
    """Last path segment of a record address, prefixed."""
    return F.concat(F.lit("bsky_"), F.substring_index(as_col(uri), "/", -1))


def normalize_posts(raw: DataFrame, query: str = "query", order: str = "ingest_seq") -> DataFrame:
    """Nested search hits to post rows; missing counts become 0. The first
    language hint and the reply count ride along for the filter."""
    zero = F.lit(0).cast("bigint")
    return raw.select(
        F.col(order).alias("ingest_seq"),
        F.lit("bluesky").alias("platform"),
        post_id("uri").alias("post_id"),
        F.col("author.handle").alias("author"),
        F.col("record.text").alias("text"),
        F.to_timestamp(F.col("record.created_at")).alias("created_at"),
        F.col(query).alias("query"),
        F.coalesce("like_count", zero).alias("likes"),
        F.coalesce("repost_count", zero).alias("reposts"),
        F.lit(False).alias("is_reply"),
        F.lit(None).cast("string").alias("parent_post_id"),
        F.get(F.col("record.langs"), F.lit(0)).alias("lang"),
        F.coalesce("reply_count", zero).alias("reply_count"),
    )


def comment_id(text: Column, parent: Column) -> Column:
    return F.concat(F.lit("reddit_"), F.substring(F.md5(F.concat(parent, F.lit(":"), text).cast("binary")), 1, 12))


def normalize_comments(df: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Comment records to post rows, with ids derived from the content."""
    sub = F.coalesce("subreddit", F.lit("unknown"))
    title = F.coalesce("parent_title", F.lit(""))
    return df.select(
        F.col(order).alias("ingest_seq"),
        F.lit("reddit").alias("platform"),
        comment_id(F.col("text"), title).alias("post_id"),
        F.lit("unknown").alias("author"),
        F.col("text"),
        F.lit("2025-01-01 00:00:00").cast("timestamp").alias("created_at"),
        F.concat(F.lit("r/"), sub, F.lit(": "), title).alias("query"),
        F.lit(0).cast("bigint").alias("likes"),
        F.lit(0).cast("bigint").alias("reposts"),
        F.lit(True).alias("is_reply"),
        comment_id(title, sub).alias("parent_post_id"),
    )


def parse_score(score: Column | str) -> Column:
    """'1.2k', '15 points', 'score hidden' to a whole number, cut toward zero."""
    low = F.lower(as_col(score))
    number = F.nullif(F.regexp_extract(low, "(-?\\p{Nd}+\\.?\\p{Nd}*)", 1), F.lit("")).try_cast("double")
    value = F.when(low.contains("k"), number * 1000).otherwise(number)
    return F.when(low.contains("hidden"), F.lit(0)).otherwise(F.coalesce(value, F.lit(0.0))).cast("bigint")


def comment_gate(df: DataFrame, score: str = "score", text: str = "text",
                 min_score: int = 5, min_len: int = 20) -> DataFrame:
    """Comments with enough votes and a body worth keeping."""
    body = F.col(text)
    return df.where(
        (parse_score(score) >= min_score)
        & (F.char_length(body) > min_len)
        & ~body.isin("[deleted]", "[removed]")
    )


def page_text(df: DataFrame, html: str = "html") -> DataFrame:
    """title and body text of landed pages; script, style and comment bodies dropped."""
    from voxtide.operators.cleaning import strip_html
    from voxtide.functions.text import collapse

    title = F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_replace(html, "(?is)<head\\b.*?</head>", " ")
    return df.withColumn("title", collapse(strip_html(title))).withColumn("body", collapse(strip_html(body)))


def cap_per_key(df: DataFrame, key: str, n: int, order: str = "ingest_seq") -> DataFrame:
    """The first n rows of every key in arrival order."""
    return top_n_per_key(df, key, n, [F.col(order)], order)


def cap_total(df: DataFrame, n: int = vocab.DEFAULT_CAP, order: str = "ingest_seq") -> DataFrame:
    """The first n rows over all sources."""
    return df.orderBy(order).limit(n)


def preset_queries(spark: SparkSession, queries: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, q in enumerate(queries or vocab.PRESET_QUERIES)],
                                 "query_no int, query string")


def match_queries(df: DataFrame, queries: DataFrame) -> DataFrame:
    """Posts of the listed queries, tagged with the position in the list."""
    return df.join(small_table(queries), "query")


def filter_min_replies(df: DataFrame, minimum: int = 0) -> DataFrame:
    """Posts worth a thread fetch; 0 means all."""
    return df.where((F.lit(minimum) <= 0) | (F.coalesce("reply_count", F.lit(0)) >= minimum))


def flatten_threads(edges: DataFrame, accept: Column, depth: int = 6, id_col: str = "post_id",
                    parent_col: str = "parent_post_id") -> DataFrame:
    """Replies reachable from the roots (rows without a parent) within `depth`
    steps over accepted rows only; a rejected reply takes its subtree along.

    The walk runs on (id, parent) pairs, one join per level, each level written
    to the shared folder; whole rows are joined once at the end. Replies of the
    HOT_KEYS parents with most children meet their parent in a broadcast of at
    most that many ids; the others shuffle. `id_col` must be unique.
    """
    roots = edges.where(F.col(parent_col).isNull()).select(F.col(id_col).alias("_pid"))
    links = edges.where(F.col(parent_col).isNotNull() & accept).select(
        F.col(id_col).alias("_id"), F.col(parent_col).alias("_parent"))
    hot = (
        links.groupBy("_parent").agg(F.count(F.lit(1)).alias("_n"))
        .orderBy(F.desc("_n"), "_parent").limit(HOT_KEYS)
        .select(F.col("_parent").alias("_hid"))
    )
    links = cut_lineage(links.join(F.broadcast(hot), F.col("_parent") == F.col("_hid"), "left"))
    of_hot = links.where(F.col("_hid").isNotNull())
    of_rest = links.where(F.col("_hid").isNull())

    levels, frontier = [], roots
    for step in range(1, depth + 1):
        to_hot = of_hot.select("_hid").distinct().join(frontier, F.col("_hid") == F.col("_pid"), "left_semi")
        found = of_rest.join(frontier, F.col("_parent") == F.col("_pid"), "left_semi").select("_id").unionByName(
            of_hot.join(F.broadcast(to_hot.select(F.col("_hid").alias("_h"))), F.col("_parent") == F.col("_h"), "left_semi").select("_id"))
        level = cut_lineage(found.withColumn("depth", F.lit(step)))
        if level.isEmpty():
            break
        levels.append(level)
        frontier = level.select(F.col("_id").alias("_pid"))
    if not levels:
        return edges.where(F.lit(False)).withColumn("depth", F.lit(0))
    reached = reduce(DataFrame.unionByName, levels)
    return edges.join(reached, F.col(id_col) == F.col("_id")).drop("_id")


def union_replies(posts: DataFrame, replies: DataFrame) -> DataFrame:
    """Posts, then replies with is_reply set, in one table."""
    posts = posts.withColumn("is_reply", F.lit(False)).withColumn("parent_post_id", F.lit(None).cast("string"))
    return posts.unionByName(replies.withColumn("is_reply", F.lit(True)), allowMissingColumns=True)


def new_rows(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows to append: the earliest of each post_id that is not stored yet,
    ingest columns only."""
    columns = [c for c in INGEST_COLUMNS if c in incoming.columns]
    # one row per key first: a key that floods the batch is trimmed on the map
    # side and does not reach the join
    firsts = first_per_key(incoming.select(*columns), ["post_id"], [F.col("ingest_seq")])
    return firsts.join(existing.select("post_id"), "post_id", "left_anti").select(*columns)


def upsert_ignore(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert-or-ignore by post_id: stored rows win, then the earliest in the batch."""
    return existing.unionByName(new_rows(existing, incoming), allowMissingColumns=True)

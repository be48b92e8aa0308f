"""Queries: sources, ingest and the rule filter."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtide.functions import vocab
from voxtide.functions.text import fuzzy_hash
from voxtide.operators import ingest, language, rules, threads
from voxtide.operators.cleaning import ENTITY, QUOTED_TAG
from voxtide.plans import jobs
from voxtide.plans.registry import (
    D_NWS, D_WORD, WORD_BODY, d_any, d_collapse, d_count, d_fuzzy, d_list, d_trim, d_values, query,
)
from voxtide.session import shared_dir
from voxtide.sources import readers, tables

LANGS = ["de", "en", "es", "fr"]
ISO = "%Y-%m-%d %H:%M:%S"


def stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def raw_posts(spark, sf):
    """The opinions table as nested search hits."""
    return tables.opinions(spark, sf).select(
        F.concat(F.lit("at://x/app.bsky.feed.post/"), F.col("ingest_seq")).alias("uri"),
        F.struct(F.col("author").alias("handle")).alias("author"),
        F.struct(
            "text",
            F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created_at"),
            F.when(F.col("lang").isNotNull(), F.array("lang")).alias("langs"),
        ).alias("record"),
        F.when(F.col("ingest_seq") % 11 != 0, F.col("likes")).alias("like_count"),
        F.when(F.col("ingest_seq") % 13 != 0, F.col("reposts")).alias("repost_count"),
        (F.col("ingest_seq") % 4).alias("reply_count"),
        "query", "ingest_seq",
    )


@query("scan_opinions", f"""select platform, post_id, author, text, strftime(created_at, '{ISO}') created_at, query, likes, reposts,
  sentiment_score, sentiment_label, is_reply, parent_post_id, relevance_score, relevance_label, cleaned_text,
  clean_status, subjectivity_label, polarity_label from stored""")
def scan_opinions(spark, sf):
    path = shared_dir(spark, "opinions")
    tables.stored(spark, sf).write.partitionBy("platform").parquet(path)
    df = readers.read_opinions(spark, path)
    return df.drop("ingest_seq").withColumn("created_at", stamp("created_at"))


@query("read_csv_records", "select coalesce(post_id, '') post_id, coalesce(text, '') text, coalesce(subjectivity_detection, '') subjectivity_detection from labelled")
def read_csv_records(spark, sf):
    path = shared_dir(spark, "records")
    tables.labelled(spark, sf).select("post_id", "text", "subjectivity_detection").write.csv(
        path, header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_records_csv(spark, path)


@query("normalize_raw_posts", f"""select 'bluesky' platform, 'bsky_' || ingest_seq post_id, author, text,
  strftime(created_at, '{ISO}') created_at, query, case when ingest_seq % 11 = 0 then 0 else likes end likes,
  case when ingest_seq % 13 = 0 then 0 else reposts end reposts, lang, ingest_seq % 4 reply_count from opinions""")
def normalize_raw_posts(spark, sf):
    df = ingest.normalize_posts(raw_posts(spark, sf))
    return df.drop("ingest_seq", "is_reply", "parent_post_id").withColumn("created_at", stamp("created_at"))


@query("post_id_from_uri", "select url, 'bsky_' || list_extract(string_split(url, '/'), -1) post_id from pages")
def post_id_from_uri(spark, sf):
    return tables.table(spark, sf, "pages").select("url", ingest.post_id("url").alias("post_id"))


D_COMMENT = "'reddit_' || substr(md5({parent} || ':' || {text}), 1, 12)"


@query("ingest_comment_jsonl", f"""select 'reddit' platform,
  {D_COMMENT.format(parent="coalesce(parent_title, '')", text='text')} post_id, 'unknown' author, text,
  '2025-01-01 00:00:00' created_at, 'r/' || coalesce(subreddit, 'unknown') || ': ' || coalesce(parent_title, '') query,
  cast(0 as bigint) likes, cast(0 as bigint) reposts, true is_reply,
  {D_COMMENT.format(parent="coalesce(subreddit, 'unknown')", text="coalesce(parent_title, '')")} parent_post_id
  from comments""")
def ingest_comment_jsonl(spark, sf):
    path = shared_dir(spark, "comments")
    tables.comments(spark, sf).drop("ingest_seq").write.json(path)
    df = readers.read_comments(spark, path).withColumn("ingest_seq", F.lit(0).cast("bigint"))
    return ingest.normalize_comments(df).drop("ingest_seq").withColumn("created_at", stamp("created_at"))


D_SCORE = """case when score is null or contains(lower(score), 'hidden') then 0 else cast(trunc(coalesce(
  try_cast(nullif(regexp_extract(lower(score), '(-?\\d+\\.?\\d*)', 1), '') as double), 0)
  * case when contains(lower(score), 'k') then 1000 else 1 end) as bigint) end"""


@query("parse_score_text", f"select ingest_seq, {D_SCORE} score_value from comments")
def parse_score_text(spark, sf):
    return tables.comments(spark, sf).select("ingest_seq", ingest.parse_score("score").alias("score_value"))


@query("comment_quality_gate", f"""select ingest_seq, text from comments
  where {D_SCORE} >= 5 and length(text) > 20 and text not in ('[deleted]', '[removed]')""")
def comment_quality_gate(spark, sf):
    return ingest.comment_gate(tables.comments(spark, sf)).select("ingest_seq", "text")


def d_strip(x: str) -> str:
    out = f"regexp_replace({x}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g')"
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    out = f"regexp_replace(regexp_replace({out}, {quote(QUOTED_TAG)}, ' ', 'g'), '</?[A-Za-z!][^>]*>', ' ', 'g')"
    names = "map {" + ", ".join(f"{quote(e)}: {quote(c)}" for e, c in vocab.HTML_ENTITIES.items()) + "}"
    code = "case when regexp_matches(e, '^&#[xX]') then cast('0x' || substr(e, 4, length(e) - 4) as bigint) else cast(regexp_extract(e, '[0-9]+') as bigint) end"
    char = f"""coalesce(case when starts_with(e, '&#') then case when {code} > 0 and {code} <= 1114111 and not {code} between 55296 and 57343 then chr(cast({code} as int)) end
      else {names}[e] end, e)"""
    found = f"list_distinct(regexp_extract_all({out}, '{ENTITY}'))"
    ordered = f"list_concat(list_filter({found}, lambda e: {char} <> '&'), list_filter({found}, lambda e: {char} = '&'))"
    return f"case when contains({out}, '&') then list_reduce(list_prepend({out}, {ordered}), lambda a, e: replace(a, e, {char})) else {out} end"


@query("page_text", f"""select page_id, {d_collapse(d_strip("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} title,
  {d_collapse(d_strip("regexp_replace(html, '(?is)<head\\b.*?</head>', ' ', 'g')"))} body from pages""")
def page_text(spark, sf):
    return ingest.page_text(tables.table(spark, sf, "pages")).select("page_id", "title", "body")


@query("cap_per_query", """select post_id, query from (select *, row_number() over (partition by query order by ingest_seq) rn
  from opinions) where rn <= 100""")
def cap_per_query(spark, sf):
    return ingest.cap_per_key(tables.opinions(spark, sf), "query", vocab.DEFAULT_CAP).select("post_id", "query")


@query("cap_total", "select post_id, ingest_seq from opinions order by ingest_seq limit 100")
def cap_total(spark, sf):
    return ingest.cap_total(tables.opinions(spark, sf), 100).select("post_id", "ingest_seq")


@query("preset_query_join", f"""select post_id, query, cast(query_no as int) query_no from opinions join
  (select unnest({d_list(vocab.PRESET_QUERIES)}) query, unnest(range({len(vocab.PRESET_QUERIES)})) query_no) using (query)""")
def preset_query_join(spark, sf):
    out = ingest.match_queries(tables.opinions(spark, sf), ingest.preset_queries(spark))
    return out.select("post_id", "query", "query_no")


@query("reply_candidates", "select 'bsky_' || ingest_seq post_id, ingest_seq % 4 reply_count from opinions where ingest_seq % 4 >= 2")
def reply_candidates(spark, sf):
    posts = ingest.normalize_posts(raw_posts(spark, sf))
    return ingest.filter_min_replies(posts, 2).select("post_id", "reply_count")


@query("union_posts_replies", """select post_id, text, false is_reply, cast(null as varchar) parent_post_id from opinions
  union all select post_id, text, true, parent_post_id from edges where parent_post_id is not null""")
def union_posts_replies(spark, sf):
    posts = tables.opinions(spark, sf).select("post_id", "text")
    replies = tables.edges(spark, sf).where("parent_post_id is not null").select("post_id", "text", "parent_post_id")
    return ingest.union_replies(posts, replies).select("post_id", "text", "is_reply", "parent_post_id")


@query("ingest_first_wins", """with incoming as (select ingest_seq, 'doc_' || cast((ingest_seq - ingest_seq % 2) * 2 as varchar) post_id, 'new ' || text as text from opinions),
  fresh as (select *, row_number() over (partition by post_id order by ingest_seq) rn from incoming where post_id not in (select post_id from opinions))
  select ingest_seq, post_id, text from opinions union all select ingest_seq, post_id, text from fresh where rn = 1""")
def ingest_first_wins(spark, sf):
    # every incoming id occurs twice, and half of the ids are stored already
    existing = tables.opinions(spark, sf).select("ingest_seq", "post_id", "text")
    incoming = existing.selectExpr(
        "ingest_seq", "'doc_' || cast((ingest_seq - ingest_seq % 2) * 2 as string) as post_id", "'new ' || text as text")
    return ingest.upsert_ignore(existing, incoming)


# ---- rule filter ---------------------------------------------------------------

D_SHORT = f"length({d_trim('text')}) < {vocab.MIN_TEXT_LENGTH}"
D_URLS = d_count("text", f"https?://{D_NWS}+")
D_TAGS = d_count("text", f"#{D_WORD}+")
D_BLOCK = d_any("lower(text)", vocab.BLOCKLIST)


D_LETTERS = "' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' '"
D_CODES = f"list_transform(string_split({D_LETTERS}, ''), lambda c: unicode(c))"
D_TERMS = (f"unnest(list_transform(range(1, greatest(len(c) - 1, 1)), lambda i: (c[i] * {language.STEP[0]} + c[i + 1] * {language.STEP[1]} + c[i + 2]) "
           f"% {language.BUCKETS})) term")
D_GRAMS = f"chars as (select ingest_seq, {D_CODES} c from opinions), grams as (select ingest_seq, {D_TERMS} from chars)"
D_PROFILE = f"""dchars as (select lang, {D_CODES} c from documents where lang in ({', '.join(f"'{l}'" for l in LANGS)})),
  dgrams as (select lang, {D_TERMS} from dchars), counts as (select lang, term, count(*) n from dgrams group by lang, term),
  wide as (select term, {', '.join(f"coalesce(sum(n) filter (lang = '{l}'), 0) n{i}" for i, l in enumerate(LANGS))} from counts group by term),
  profile as (select term, {', '.join(f"cast(round(ln(cast(n{i} + 1 as double) / cast((select sum(n{i}) + count(*) from wide) as double)) * 1000) as bigint) w{i}" for i in range(len(LANGS)))} from wide)"""
D_DETECT = f"""{D_GRAMS}, {D_PROFILE},
  votes as (select ingest_seq, {', '.join(f'coalesce(sum(w{i}), 0) v{i}' for i in range(len(LANGS)))} from grams join profile using (term) group by ingest_seq),
  found as (select ingest_seq, case when v0 < 0 then {d_list(LANGS)}[list_position([v0, v1, v2, v3], greatest(v0, v1, v2, v3))] end detected from votes)"""


def d_row_reason() -> str:
    """Needs the common tables of D_DETECT and a join with `found`."""
    return f"""case when {D_SHORT} then 'min_text_length'
  when not (case when lang is not null then starts_with(lang, 'en') else coalesce(detected = 'en', true) end) then 'language'
  when {D_URLS} > {vocab.MAX_URLS} then 'url_density'
  when {D_TAGS} > {vocab.MAX_HASHTAGS} then 'hashtag_density'
  when {D_BLOCK} then 'keyword_blocklist' end"""


def d_reasons(source: str = "opinions", scope: str = "0") -> str:
    """Common tables of the detection, and `reasons`: the source rows with their first failing rule."""
    return f"""{D_DETECT}, judged as (select s.*, {d_row_reason()} row_reason, {d_fuzzy('text')} h, {scope} scope from {source} s left join found using (ingest_seq)),
  firsts as (select scope, h, arg_min(text, ingest_seq) first_text from judged where row_reason is null group by scope, h),
  reasons as (select j.* exclude (row_reason, h, scope), coalesce(row_reason, case when f.first_text <> j.text then 'near_duplicate' end) reason
    from judged j left join firsts f on f.h = j.h and f.scope = j.scope)"""


@query("rule_min_length", f"select post_id, {D_SHORT} fails from opinions")
def rule_min_length(spark, sf):
    return tables.opinions(spark, sf).select("post_id", rules.too_short("text").alias("fails"))


def profile_of(spark, sf):
    return language.language_profile(tables.documents(spark, sf), LANGS)


@query("lang_detect", f"with {D_DETECT} select post_id, detected from opinions left join found using (ingest_seq)")
def lang_detect(spark, sf):
    return language.detect_language(tables.opinions(spark, sf), profile_of(spark, sf))


@query("rule_language", f"""with {D_DETECT} select post_id,
  case when lang is not null then starts_with(lang, 'en') else coalesce(detected = 'en', true) end passes
  from opinions left join found using (ingest_seq)""")
def rule_language(spark, sf):
    df = language.with_detected(tables.opinions(spark, sf), profile_of(spark, sf))
    return df.select("post_id", rules.english("lang", "detected").alias("passes"))


@query("rule_url_density", f"select post_id, {D_URLS} urls, {D_URLS} > 3 fails from opinions")
def rule_url_density(spark, sf):
    n = rules.url_count("text")
    return tables.opinions(spark, sf).select("post_id", n.cast("bigint").alias("urls"), (n > vocab.MAX_URLS).alias("fails"))


@query("rule_hashtag_density", f"select post_id, {D_TAGS} hashtags, {D_TAGS} > 5 fails from opinions")
def rule_hashtag_density(spark, sf):
    n = rules.hashtag_count("text")
    return tables.opinions(spark, sf).select("post_id", n.cast("bigint").alias("hashtags"), (n > vocab.MAX_HASHTAGS).alias("fails"))


@query("rule_blocklist", f"select post_id, {D_BLOCK} fails from opinions")
def rule_blocklist(spark, sf):
    return tables.opinions(spark, sf).select("post_id", rules.blocklisted("text").alias("fails"))


@query("fuzzy_hash", f"select post_id, {d_fuzzy('text')} h from opinions")
def fuzzy_hash_query(spark, sf):
    return tables.opinions(spark, sf).select("post_id", fuzzy_hash("text").alias("h"))


@query("rule_near_duplicate", f"with {d_reasons()} select post_id, coalesce(reason = 'near_duplicate', false) fails from reasons")
def rule_near_duplicate(spark, sf):
    df = rules.rejection_reasons(tables.opinions(spark, sf), profile_of(spark, sf))
    return df.select("post_id", F.coalesce(F.col("reason") == "near_duplicate", F.lit(False)).alias("fails"))


@query("rejection_reason", f"with {d_reasons()} select post_id, reason from reasons")
def rejection_reason(spark, sf):
    return rules.rejection_reasons(tables.opinions(spark, sf), profile_of(spark, sf)).select("post_id", "reason")


@query("ingest_run", f"""with raw as (select * exclude (post_id), 'bsky_' || ingest_seq post_id from opinions), {d_reasons('raw')},
  capped as (select *, row_number() over (partition by query order by ingest_seq) rn from reasons where reason is null)
  select post_id, 'bluesky' platform, query, text from capped where rn <= 100
  union all select post_id, 'reddit', query, text from (select {D_COMMENT.format(parent="coalesce(parent_title, '')", text='text')} post_id,
    'r/' || coalesce(subreddit, 'unknown') || ': ' || coalesce(parent_title, '') query, text from comments)""")
def ingest_run(spark, sf):
    stored = ingest.normalize_comments(tables.comments(spark, sf))
    return jobs.ingest_run(stored, raw_posts(spark, sf), profile_of(spark, sf)).select("post_id", "platform", "query", "text")


@query("rule_filter", f"with {d_reasons()} select post_id, text from reasons where reason is null")
def rule_filter(spark, sf):
    return rules.rule_filter(tables.opinions(spark, sf), profile_of(spark, sf)).select("post_id", "text")


@query("rejection_summary", f"with {d_reasons()} select coalesce(reason, 'accepted') reason, count(*) n from reasons group by 1")
def rejection_summary(spark, sf):
    return rules.rejection_summary(tables.opinions(spark, sf), profile_of(spark, sf))


@query("filter_session_scope", f"with {d_reasons(scope='platform')} select post_id, platform, reason from reasons")
def filter_session_scope(spark, sf):
    return rules.rejection_reasons(tables.opinions(spark, sf), profile_of(spark, sf), session="platform").select("post_id", "platform", "reason")


@query("flatten_reply_tree", f"""with recursive {D_DETECT.replace('from opinions', 'from edges')},
  judged as (select post_id, parent_post_id, ingest_seq, text, {d_fuzzy('text')} h, (parent_post_id is null or node_type = 'threadViewPost') and {d_row_reason()} is null ok
    from edges left join found using (ingest_seq)),
  paths as (select post_id, [ingest_seq] path, ok from judged where parent_post_id is null
    union all select j.post_id, list_append(p.path, j.ingest_seq), j.ok from judged j join paths p on j.parent_post_id = p.post_id where len(p.path) <= 6),
  turns as (select j.*, path, row_number() over (order by len(path) > 1, path) i from judged j join paths using (post_id)),
  -- one row after the other, with what was dropped and what is remembered so far
  walk as (select cast(0 as bigint) i, cast([] as varchar[]) dropped, cast([] as varchar[]) hashes, cast([] as varchar[]) texts
    union all select t.i,
      case when not t.ok or list_contains(dropped, parent_post_id) or (list_contains(hashes, t.h) and texts[list_position(hashes, t.h)] <> t.text) then list_append(dropped, t.post_id) else dropped end,
      case when t.ok and not coalesce(list_contains(dropped, parent_post_id), false) and not list_contains(hashes, t.h) then list_append(hashes, t.h) else hashes end,
      case when t.ok and not coalesce(list_contains(dropped, parent_post_id), false) and not list_contains(hashes, t.h) then list_append(texts, t.text) else texts end
    from walk w join turns t on t.i = w.i + 1)
  select post_id, parent_post_id, cast(len(path) - 1 as int) depth from turns
  where len(path) > 1 and not list_contains((select dropped from walk order by i desc limit 1), post_id)""")
def flatten_reply_tree(spark, sf):
    out = threads.judged_threads(tables.edges(spark, sf), profile_of(spark, sf), F.col("node_type") == "threadViewPost", 6)
    return out.select("post_id", "parent_post_id", "depth")

"""Queries: search, export and streaming."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import functions as F

from voxtide.functions import vocab
from voxtide.operators import export, labels, rules, search, sentiment
from voxtide.plans import jobs
from voxtide.plans.catalog_ingest import D_DETECT, d_row_reason, profile_of
from voxtide.plans.catalog_labels import scored, stage1_map, stage2_map
from voxtide.plans.catalog_text import D_LABEL, d_sentiment
from voxtide.plans.registry import WORD_BODY, query
from voxtide.session import shared_dir
from voxtide.sources import readers, tables
from voxtide.streaming import jobs as streams

PHRASE, RARE = "of the", "great and not bad"
D_ISO = "strftime(created_at, '%Y-%m-%dT%H:%M:%S') || '+00:00'"

# ---- search -------------------------------------------------------------------------

D_FIELDS = f"""fields as (select post_id, 'text' field, regexp_extract_all(lower(text), '[{WORD_BODY}]+') toks from stored
  union all select post_id, 'cleaned_text', regexp_extract_all(lower(coalesce(cleaned_text, '')), '[{WORD_BODY}]+') from stored),
  occ as (select post_id, field, unnest(toks) term, unnest(range(0, len(toks))) pos from fields)"""


def d_hits(phrase: str) -> str:
    """Common table `hits`: post_id, field, freq of the phrase, by joining its terms."""
    terms = search.query_terms(phrase)
    joins = " ".join(
        f"join occ o{i} on o{i}.post_id = o0.post_id and o{i}.field = o0.field and o{i}.pos = o0.pos + {i} and o{i}.term = '{t}'"
        for i, t in enumerate(terms) if i)
    return f"""{D_FIELDS}, hits as (select o0.post_id, o0.field, count(*) freq from occ o0 {joins} where o0.term = '{terms[0]}' group by all)"""


def d_scores(phrase: str) -> str:
    terms = sorted(set(search.query_terms(phrase)))
    df = ", ".join(f"count(*) filter (list_contains(toks, '{t}')) d{i}" for i, t in enumerate(terms))
    idf = " + ".join(f"ln(1 + (n - d{i} + 0.5::double) / (d{i} + 0.5::double))" for i in range(len(terms)))
    return f"""{d_hits(phrase)}, fs as (select field, count(*) n, avg(len(toks)) avg_len, {df} from fields where len(toks) > 0 group by field),
  scores as (select post_id, sum(({idf}) * freq * 2.2::double / (freq + 1.2::double * (0.25::double + 0.75::double * len(toks) / avg_len))) score
    from hits join fields using (post_id, field) join fs using (field) group by post_id)"""


def index_folder(spark, sf) -> str:
    """Where the application keeps the table's index; the same folder for every query."""
    return os.path.join(os.path.dirname(shared_dir(spark, "index")), "index-" + hashlib.sha256(sf.encode()).hexdigest()[:16])


def index_of(spark, sf) -> search.Index:
    """The table's index as the table is now: its files are looked at in every query,
    those that are new or changed are indexed, and a folder that is gone is made anew."""
    return search.refresh_index(tables.documents(spark, sf), tables.stored_of, index_folder(spark, sf), term_buckets=64)


@query("search_index", f"""with {D_FIELDS} select field, (select count(*) from fields g where g.field = o.field and len(toks) > 0) n_docs,
  count(*) total_len, count(distinct term) n_terms from occ o group by field""")
def search_index(spark, sf):
    """A new index of the whole table, told by its fields."""
    index = search.refresh_index(tables.documents(spark, sf), tables.stored_of, shared_dir(spark, "index"), term_buckets=64)
    terms = index.read(spark, "terms").groupBy("field").agg(F.count(F.lit(1)).alias("n_terms"))
    return index.read(spark, "fields").join(terms, "field").select("field", "n_docs", "total_len", "n_terms")


@query("index_documents", f"""with {D_FIELDS} select field, term, post_id, array_to_string(list_sort(list(pos)), ' ') positions, count(*) tf from occ group by field, term, post_id""")
def index_documents(spark, sf):
    return search.index_documents(tables.stored(spark, sf)).withColumn("positions", F.array_join("positions", " "))


@query("phrase_match", f"with {d_hits(PHRASE)} select distinct post_id from hits")
def phrase_match(spark, sf):
    return search.phrase_match(tables.stored(spark, sf), PHRASE)


@query("phrase_match_indexed", f"with {d_hits(PHRASE)} select distinct post_id from hits")
def phrase_match_indexed(spark, sf):
    return search.phrase_match(tables.stored(spark, sf), PHRASE, index=index_of(spark, sf))


@query("relevance_score", f"with {d_scores(PHRASE)} select post_id, round(score, 6) score from scores")
def relevance_score(spark, sf):
    return search.relevance_scores(tables.stored(spark, sf), PHRASE, index=index_of(spark, sf)).withColumn("score", F.round("score", 6))


@query("sentiment_filter", "select post_id, sentiment_label from stored where sentiment_label in ('positive', 'neutral')")
def sentiment_filter(spark, sf):
    return search.sentiment_filter(tables.stored(spark, sf), ["positive", "neutral"]).select("post_id", "sentiment_label")


D_DATES = "created_at >= timestamp '2024-01-05' and created_at < timestamp '2024-01-21'"


@query("date_range_filter", f"select post_id from stored where {D_DATES}")
def date_range_filter(spark, sf):
    return search.date_range_filter(tables.stored(spark, sf), "2024-01-05", "2024-01-20").select("post_id")


@query("search_sort", """select post_id, cast(row_number() over (order by likes desc, post_id) as bigint) rank from stored
  order by likes desc, post_id limit 50""")
def search_sort(spark, sf):
    page = search.paginate(tables.stored(spark, sf), search.sort_columns("likes"), 0, 50)
    from pyspark.sql.window import Window as W

    # the page holds 50 rows
    return page.select("post_id", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*search.sort_columns("likes"))).cast("bigint").alias("rank"))


@query("paginate", "select post_id, likes from stored order by created_at desc, post_id limit 10 offset 20")
def paginate(spark, sf):
    return search.paginate(tables.stored(spark, sf), search.sort_columns("date_desc"), 20, 10).select("post_id", "likes")


D_MATCH = f"{d_scores(RARE)}, matches as (select s.*, score from stored s join scores using (post_id) where {D_DATES.replace('2024-01-21', '2026-01-01')} and sentiment_label in ('positive', 'negative'))"


def matches(spark, sf):
    return search.match_set(tables.stored(spark, sf), RARE, ["positive", "negative"], "2024-01-05", "2025-12-31", index=index_of(spark, sf))


@query("num_found", f"with {D_MATCH} select count(*) num_found from matches")
def num_found(spark, sf):
    return search.num_found(matches(spark, sf))


@query("sentiment_facets", f"with {D_MATCH} select sentiment_label, count(*) n from matches group by 1")
def sentiment_facets(spark, sf):
    return search.sentiment_facets(matches(spark, sf))


@query("facet_percentages", f"with {D_MATCH} select sentiment_label, count(*) n, round(count(*) * 100.0::double / sum(count(*)) over (), 1) pct from matches group by 1")
def facet_percentages(spark, sf):
    return search.facet_percentages(search.sentiment_facets(matches(spark, sf)))


def d_highlight(phrase: str) -> str:
    gap = f"[^{WORD_BODY}]+"
    body = gap.join(search.query_terms(phrase))
    pattern = f"(?i)(^|[^{WORD_BODY}])({body})([^{WORD_BODY}]|$)"
    return f"""case when regexp_matches(text, '{pattern}') then regexp_replace(text, '{pattern}', '\\1<mark>\\2</mark>\\3', 'g') else left(text, 200) || '...' end"""


@query("highlight", f"select post_id, {d_highlight(RARE)} highlighted_text from stored")
def highlight(spark, sf):
    return tables.stored(spark, sf).select("post_id", search.highlight("text", RARE).alias("highlighted_text"))


@query("search", f"""with {D_MATCH}, page as (select * from matches order by score desc, post_id limit 10)
  select post_id, round(score, 6) score, {d_highlight(RARE)} highlighted_text, (select count(*) from matches) num_found,
  (select string_agg(sentiment_label || '=' || n, ' ' order by sentiment_label) from (select sentiment_label, count(*) n from matches group by 1)) facets from page""")
def search_query(spark, sf):
    result = search.search(tables.stored(spark, sf), RARE, ["positive", "negative"], "2024-01-05", "2025-12-31", index=index_of(spark, sf))
    facets = result.facets.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "sentiment_label", "n"))), " ").alias("facets"))
    return result.docs.select("post_id", F.round("score", 6).alias("score"), "highlighted_text",
                              result.num_found.scalar().alias("num_found"), facets.scalar().alias("facets"))


# ---- export ----------------------------------------------------------------------------

D_EXPORT = "platform = 'bluesky' and (relevance_label is null or relevance_label = 'relevant') and not coalesce(clean_status in ('bot', 'too_short', 'duplicate'), false)"


@query("export_filter", f"select post_id, clean_status, relevance_label from stored where {D_EXPORT}")
def export_filter(spark, sf):
    out = export.export_filter(tables.stored(spark, sf), platform="bluesky", relevant_only=True, exclude_rejected=True)
    return out.select("post_id", "clean_status", "relevance_label")


D_COLS = f"""platform, post_id, author, {{text}} as text, {D_ISO} created_at, query, likes, reposts, sentiment_score, sentiment_label, is_reply, parent_post_id,
  relevance_score, relevance_label, {{extra}} subjectivity_label, polarity_label"""
D_FULL = D_COLS.format(text="text", extra="cleaned_text, clean_status,")


D_CLEAN = D_COLS.format(text="coalesce(nullif(cleaned_text, ''), text)", extra="")


@query("export_projection", f"select {D_CLEAN} from stored")
def export_projection(spark, sf):
    return export.export_projection(tables.stored(spark, sf), clean_text_only=True)


@query("export_csv", f"""select post_id, text, {D_ISO} created_at, cast(likes as varchar) likes, case when is_reply then 'True' else 'False' end is_reply,
  coalesce(parent_post_id, '') parent_post_id, coalesce(cleaned_text, '') cleaned_text, coalesce(sentiment_label, '') sentiment_label from stored""")
def export_csv(spark, sf):
    path = shared_dir(spark, "csv")
    export.export_csv(export.export_projection(tables.stored(spark, sf)), path)
    return readers.read_records_csv(spark, path).select(
        "post_id", "text", "created_at", "likes", "is_reply", "parent_post_id", "cleaned_text", "sentiment_label")


def read_json(spark, path, df, **options):
    return spark.read.schema(df.schema).json(path, **options)


@query("export_json", f"select {D_FULL} from stored")
def export_json(spark, sf):
    path = shared_dir(spark, "json")
    df = export.export_projection(tables.stored(spark, sf))
    export.export_json(df, path)
    return read_json(spark, path, df, multiLine=True)


@query("export_jsonl", f"select {D_FULL} from stored")
def export_jsonl(spark, sf):
    path = shared_dir(spark, "jsonl")
    df = export.export_projection(tables.stored(spark, sf))
    export.export_jsonl(df, path)
    return read_json(spark, path, df)


@query("predictions_jsonl", """select post_id, case when opinionated_score >= 0.5 then 'opinionated' else 'neutral' end stage1_label,
  case when opinionated_score >= 0.5 then case when positive_score >= 0.5 then 'positive' else 'negative' end else 'neutral' end final_label from scored""")
def predictions_jsonl(spark, sf):
    path = shared_dir(spark, "predictions")
    out = labels.hierarchical_predict(
        scored(spark, sf), lambda d: d.withColumn("scores", stage1_map()), lambda d: d.withColumn("scores", stage2_map()))
    out = out.select("post_id", "stage1_label", "final_label")
    export.predictions_jsonl(out, path)
    return read_json(spark, path, out)


# ---- streaming ---------------------------------------------------------------------------


def land(df, path, late_copy: bool):
    """Write a table as arriving files, optionally with a late, changed copy of all rows."""
    df.write.parquet(path)
    if late_copy:
        df.withColumn("ingest_seq", F.col("ingest_seq") + 10**12).withColumn(
            "text", F.concat(F.lit("late "), "text")).write.mode("append").parquet(path)


@query("stream_ingest_dedup", "select post_id, ingest_seq, text from opinions")
def stream_ingest_dedup(spark, sf):
    landed, stored, checkpoint = (shared_dir(spark, n) for n in ("landed", "stored", "state"))
    df = tables.opinions(spark, sf).select("ingest_seq", "platform", "post_id", "text", "created_at")
    land(df, landed, late_copy=True)
    stream = streams.file_stream(spark, landed, df.schema, files_per_trigger=8)
    streams.run_to_end(streams.dedup_ingest(stream, stored, checkpoint))
    return spark.read.schema(df.schema).parquet(stored).select("post_id", "ingest_seq", "text")


@query("stream_annotate", f"""with {d_sentiment('opinions')}, {D_DETECT} select post_id, {d_row_reason()} row_reason, sentiment_score, {D_LABEL} sentiment_label
  from opinions join sentiment using (post_id) left join found using (ingest_seq)""")
def stream_annotate(spark, sf):
    landed, stored, checkpoint = (shared_dir(spark, n) for n in ("landed", "annotated", "state"))
    df = tables.opinions(spark, sf).select("post_id", "text", "lang")
    land(df, landed, late_copy=False)
    lexicon, detector = sentiment.lexicon_table(spark), profile_of(spark, sf)

    def label(batch):
        tagged = rules.with_row_reason(batch, detector).withColumnRenamed("_row_reason", "row_reason")
        scores = sentiment.lexicon_sentiment(tagged, lexicon, ["post_id", "row_reason"])
        return scores.withColumn("sentiment_label", sentiment.sentiment_label("sentiment_score"))

    stream = streams.file_stream(spark, landed, df.schema, files_per_trigger=8)
    streams.run_to_end(streams.annotate(stream, label, stored, checkpoint))
    return spark.read.schema("post_id string, row_reason string, sentiment_score double, sentiment_label string").parquet(stored).drop("batch")

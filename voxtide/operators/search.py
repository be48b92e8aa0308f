"""Phrase search over the post table: postings, match, rank, page, facets.

A phrase is matched by votes: an occurrence of the i-th query term at position p
votes for a phrase that starts at p - i; a start with as many votes as the query
has terms is a hit. That is one grouped count with map-side combine, whatever the
number of terms, and only occurrences of query terms are shuffled.

Occurrences are grouped into postings inside the task that reads a document: what is
shuffled for an index are blocks of postings, a term and field once for all the
documents of a batch.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.functions.text import WORD_BODY, tokens
from voxtide.operators.metrics import ratio
from voxtide.session import cut_lineage

FIELDS = ["text", "cleaned_text"]
K1, B = 1.2, 0.75
# Sort keys.
SORTS = {
    "relevance": [("score", False)],
    "likes": [("likes", False)],
    "reposts": [("reposts", False)],
    "date_desc": [("created_at", False)],
    "date_asc": [("created_at", True)],
}


def analyze(text: Column | str) -> Column:
    return tokens(F.lower(F.col(text) if isinstance(text, str) else text))


def query_terms(query: str) -> list[str]:
    return re.findall(r"\w+", query.lower())


def occurrences(df: DataFrame, fields: list[str] = FIELDS, key: str = "post_id") -> DataFrame:
    """field, post_id, term, pos for every token of the analysed fields."""
    both = F.array(*[
        F.struct(F.lit(f).alias("field"), analyze(F.coalesce(f, F.lit(""))).alias("toks")) for f in fields
    ])
    per_field = df.select(key, F.explode_outer(both).alias("f")).select(key, "f.field", "f.toks")
    return per_field.select("field", key, F.posexplode_outer("toks").alias("pos", "term")).where(F.col("term").isNotNull())


def repeated_keys(df: DataFrame, key: str = "post_id") -> DataFrame | None:
    """_key of the keys (null is one) that several rows of df have; None if there are
    none. Keys alone are shuffled."""
    many = cut_lineage(df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_key", F.lit(True).alias("_again")))
    return None if many.isEmpty() else many


def marked(df: DataFrame, many: DataFrame | None, key: str = "post_id") -> DataFrame:
    """df plus `_again`: another row has the same key."""
    if many is None:
        return df.withColumn("_again", F.lit(False))
    joined = df.join(many, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.select(*df.columns, F.coalesce("_again", F.lit(False)).alias("_again"))


BLOCK_TOKENS = 1 << 22


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with about BLOCK_TOKENS tokens at a time."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch["toks"]).to_numpy())
        at = 0
        while at < batch.num_rows:
            limit = BLOCK_TOKENS + (ends[at - 1] if at else 0)
            to = max(at + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _postings(batch: pa.RecordBatch, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """One entry per row and term, by part (a number per row), term and row: number of
    the row, of the term, and where its positions begin; the positions, and the terms."""
    lens = pc.list_value_length(batch["toks"]).to_numpy().astype(np.int64)
    words = batch["toks"].flatten().dictionary_encode()
    row, code = np.repeat(np.arange(len(lens)), lens), words.indices.to_numpy().astype(np.int64)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
    group = (part[row] * len(words.dictionary) + code) * len(lens) + row
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.diff(group[order], prepend=-1))
    return row[order[first]], code[order[first]], first, pos[order], words.dictionary


def _lists(first: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists that begin at `first`, one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.append(first, len(values)), pa.int32()), values)


def document_postings(df: DataFrame, fields: list[str] = FIELDS, key: str = "post_id") -> DataFrame:
    """field, term, post_id, positions, tf of each row of df by itself; nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, code, first, pos, terms = _postings(batch, np.arange(batch.num_rows))
            at, positions = pa.array(row), _lists(first, pa.array(pos, pa.int32()))
            yield pa.record_batch({"field": batch["field"].take(at), "term": terms.take(pa.array(code)), key: batch[key].take(at),
                                   "positions": positions, "tf": pc.list_value_length(positions).cast(pa.int64())})

    kind = df.schema[key].dataType.simpleString()
    return field_tokens(df, fields, key).mapInArrow(run, f"field string, term string, `{key}` {kind}, positions array<int>, tf bigint")


def index_documents(df: DataFrame, fields: list[str] = FIELDS, key: str = "post_id") -> DataFrame:
    """field, term, post_id, positions, tf. A list never grows beyond one document.
    Only documents that share their key are brought together; the others have their
    lists made where they lie."""
    many = repeated_keys(df, key)
    if many is None:
        return document_postings(df, fields, key)
    rows = marked(df, many, key)
    several = document_postings(rows.where("_again"), fields, key).groupBy("field", "term", key).agg(
        F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.sum("tf").alias("tf"))
    return document_postings(rows.where("not _again"), fields, key).unionByName(several)


def posting_blocks(df: DataFrame, fields: list[str] = FIELDS, key: str = "post_id") -> DataFrame:
    """field, term, again, keys, lens, starts, positions, n_own: for each batch of documents
    those that hold a term, apart by whether other rows have their key; by document the
    length of the field and where its positions start in those of the block. n_own is
    how many have a key that is theirs alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            part = batch["field"].dictionary_encode().indices.to_numpy().astype(np.int64) * 2 + batch["_again"].to_numpy(zero_copy_only=False)
            row, code, starts, pos, terms = _postings(batch, part)
            first = np.flatnonzero(np.diff(part[row] * len(terms) + code, prepend=-1))
            keys, again = batch[key].take(pa.array(row)), batch["_again"].to_numpy(zero_copy_only=False)[row]
            own = np.add.reduceat(keys.is_valid().to_numpy(zero_copy_only=False) & ~again, first, dtype=np.int64)
            within = starts - np.repeat(starts[first], np.diff(np.append(first, len(row))))
            at = pa.array(row[first])
            yield pa.record_batch({
                "field": batch["field"].take(at), "term": terms.take(pa.array(code[first])), "again": pa.array(again[first]), "keys": _lists(first, keys),
                "lens": _lists(first, batch["len"].take(pa.array(row)).cast(pa.int32())), "starts": _lists(first, pa.array(within, pa.int32())),
                "positions": _lists(starts[first], pa.array(pos, pa.int32())), "n_own": pa.array(own)})

    kind = df.schema[key].dataType.simpleString()
    schema = f"field string, term string, again boolean, keys array<{kind}>, lens array<int>, starts array<int>, positions array<int>, n_own bigint"
    return field_tokens(df, fields, key, ["_again"]).mapInArrow(run, schema)


def field_stats(df: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """field, n_docs, avg_len, total_len over documents whose field is not empty."""
    sizes = F.array(*[
        F.struct(F.lit(f).alias("field"), F.regexp_count(F.lower(F.coalesce(f, F.lit(""))), F.lit(f"[{WORD_BODY}]+")).alias("len")) for f in fields
    ])
    flat = df.select(F.explode_outer(sizes).alias("s")).select("s.*").where(F.col("len") > 0)
    return flat.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"), F.sum("len").alias("total_len"))


def _bucket(term_buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(term_buckets)).cast("int")


def write_index(df: DataFrame, path: str, fields: list[str] = FIELDS, term_buckets: int = 256,
                key: str = "post_id") -> None:
    """Postings in blocks, laid out by a hash of the term: a search opens the folders of
    its own terms only, and inside them the sort order lets Parquet skip the other
    terms. The blocks of a frequent term are spread over 64 parts. Beside them, in how
    many documents each term stands, and the number and mean length of the fields."""
    many = repeated_keys(df, key)
    blocks = posting_blocks(marked(df, many, key), fields, key)
    (blocks.withColumn("bucket", _bucket(term_buckets))
     .repartition("bucket", F.pmod(F.xxhash64(F.get("keys", F.lit(0))), F.lit(64)))
     .sortWithinPartitions("bucket", "term")
     .write.partitionBy("bucket").parquet(f"{path}/postings"))
    postings, term = df.sparkSession.read.parquet(f"{path}/postings"), ["bucket", "term", "field"]
    counted = postings.groupBy(*term).agg(F.sum("n_own").alias("n_docs"))
    if many is not None:
        shared = postings.where("again").select(*term, F.explode("keys").alias("k")).groupBy(*term).agg(F.countDistinct("k").alias("n_docs"))
        counted = counted.unionByName(shared).groupBy(*term).agg(F.sum("n_docs").alias("n_docs"))
    counted.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")
    field_stats(df, fields).write.parquet(f"{path}/fields")


@dataclass(frozen=True)
class Index:
    """A written index: one folder, or the segments of one, each an index of some rows."""

    path: str
    term_buckets: int = 256
    segments: tuple[str, ...] = ()
    key: str = "post_id"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [spark.read.parquet(f"{p}/{table}") for p in self.segments or (self.path,)])

    def _of_terms(self, spark: SparkSession, table: str, terms: list[str]) -> DataFrame:
        wanted = spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string")
        buckets = [r[0] for r in wanted.select(_bucket(self.term_buckets)).distinct().collect()]  # one per query term
        return self.read(spark, table).where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).drop("bucket")

    def occurrences(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """field, post_id, len, pos, term of the given terms."""
        end = lambda i: F.coalesce(F.get("starts", i + 1), F.size("positions"))
        docs = F.transform("keys", lambda k, i: F.struct(k.alias(self.key), F.get("lens", i).cast("bigint").alias("len"),
                           F.slice("positions", F.get("starts", i) + 1, end(i) - F.get("starts", i)).alias("positions")))
        each = self._of_terms(spark, "postings", terms).select("field", "term", F.inline(docs))
        return each.select("field", self.key, "len", F.explode("positions").alias("pos"), "term")

    def statistics(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """field, n_docs, avg_len, df0, df1, ... for the given terms in order: one row per field."""
        found = self._of_terms(spark, "terms", terms).groupBy(F.col("field").alias("f")).agg(
            *[F.coalesce(F.sum(F.when(F.col("term") == t, F.col("n_docs"))), F.lit(0)).alias(f"df{i}") for i, t in enumerate(terms)])
        fields = self.read(spark, "fields").groupBy("field").agg(F.sum("n_docs").alias("n_docs"), (F.sum("total_len") / F.sum("n_docs")).alias("avg_len"))
        return fields.join(F.broadcast(found), F.col("field") == F.col("f")).drop("f")


MAX_SEGMENTS = 16
MANIFEST = "segment string, term_buckets int, file string, size bigint, time timestamp, version bigint"


def table_files(source: DataFrame) -> dict[str, tuple]:
    """Size and time of every file that holds rows of a table, from the rows' metadata."""
    rows = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def read_manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, dict[str, tuple]], int]:
    """Version, files by segment, and term buckets of the index in a folder; version 0 if it holds none."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()  # one row per file of the table
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return 0, {}, 0
    last = max((r.version for r in rows), default=0)
    segments: dict[str, dict[str, tuple]] = {}
    for r in rows:
        if r.version == last:
            segments.setdefault(r.segment, {})[r.file] = (r.size, r.time)
    return last, segments, max((r.term_buckets for r in rows if r.version == last), default=0)


def refresh_index(source: DataFrame, view: Callable[[DataFrame], DataFrame], path: str, fields: list[str] = FIELDS,
                  term_buckets: int = 256, key: str = "post_id") -> Index:
    """The index in a folder, brought to what the table `source` is now.

    A segment knows which files it was made of, with their sizes and times. Files that
    no segment knows become a new segment, so a table that grows costs what was added;
    a segment with a file that has changed or gone is left out and its other files are
    indexed anew. Beyond MAX_SEGMENTS all become one. `view` makes the documents of the
    table's rows, each of them from one row; statistics are sums over the segments, so
    results are those of one index over all rows.

    The manifest is written last and names whole segments: a run that breaks off leaves
    the version before in force. Nothing is remembered outside the folder.
    """
    spark = source.sparkSession
    version, segments, buckets = read_manifest(spark, path)
    now = table_files(source)
    whole = {s: f for s, f in segments.items() if buckets == term_buckets and all(now.get(x) == v for x, v in f.items())}
    known = {x for f in whole.values() for x in f}
    fresh = {x: v for x, v in now.items() if x not in known}
    if whole == segments and not fresh and version:
        return Index(path, term_buckets, tuple(f"{path}/{s}" for s in sorted(whole)), key)
    if len(whole) + 1 > MAX_SEGMENTS:
        whole, fresh = {}, now
    if fresh:
        name = f"segment-{uuid.uuid4().hex}"
        write_index(view(spark.read.schema(source.schema).parquet(*sorted(fresh))), f"{path}/{name}", fields, term_buckets, key)
        whole[name] = fresh
    rows = [(s, term_buckets, x, *v, version + 1) for s, f in whole.items() for x, v in f.items()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return Index(path, term_buckets, tuple(f"{path}/{s}" for s in sorted(whole)), key)


def phrase_hits(occ: DataFrame, terms: list[str], key: str = "post_id") -> DataFrame:
    """field, post_id, len, freq: how often the phrase starts in each field."""
    if len(terms) == 1:
        return occ.where(F.col("term") == terms[0]).groupBy("field", key, "len").agg(F.count(F.lit(1)).alias("freq"))
    offsets = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(terms)])
    mine = F.filter(offsets, lambda o: o["t"] == F.col("term"))
    starts = (
        occ.where(F.col("term").isin(sorted(set(terms))))
        .select("field", key, "len", "pos", F.explode(mine).alias("o"))
        .groupBy("field", key, "len", (F.col("pos") - F.col("o.i")).alias("start"))
        .agg(F.count(F.lit(1)).alias("votes"))
        .where(F.col("votes") == len(terms))
    )
    return starts.groupBy("field", key, "len").agg(F.count(F.lit(1)).alias("freq"))


def field_tokens(df: DataFrame, fields: list[str] = FIELDS, key: str = "post_id", carry: list[str] = []) -> DataFrame:
    """post_id, field, toks, len of the fields that hold any token, and the carried columns."""
    docs = F.array(*[
        F.struct(F.lit(f).alias("field"), analyze(F.coalesce(f, F.lit(""))).alias("toks")) for f in fields
    ])
    flat = df.select(key, *carry, F.explode_outer(docs).alias("f")).select(
        key, "f.field", F.col("f.toks").alias("toks"), F.size("f.toks").cast("bigint").alias("len"), *carry)
    return flat.where(F.col("len") > 0)


def phrase_match(df: DataFrame, query: str, fields: list[str] = FIELDS, key: str = "post_id",
                 index: Index | None = None) -> DataFrame:
    """post_id of rows that hold the whole query as a phrase in any field; `*` is
    everything, a query without a word nothing. With an index only the postings of
    its terms are read; without, the texts are read once and each row decides for itself."""
    if query == "*":
        return df.select(key)
    terms = query_terms(query)
    if not terms:
        return df.select(key).where(F.lit(False))
    if index:
        return phrase_hits(index.occurrences(df.sparkSession, terms), terms, key).select(key).distinct()
    return phrase_starts(field_tokens(df, fields, key), terms, key).select(key).distinct()


def relevance_scores(df: DataFrame, query: str, fields: list[str] = FIELDS, key: str = "post_id",
                     index: Index | None = None) -> DataFrame:
    """post_id, score: BM25 of the phrase, summed over the fields it occurs in.

    Phrase frequency stands for tf and the idf is the sum over the distinct
    terms. Statistics are one row per field, joined by broadcast. With an index no
    text is read.
    """
    terms = query_terms(query)
    if not terms:
        return df.select(key, F.lit(0.0).alias("score")).where(F.lit(False))
    distinct = sorted(set(terms))
    if index:
        stats = index.statistics(df.sparkSession, distinct)
        hits = phrase_hits(index.occurrences(df.sparkSession, terms), terms, key)
    else:
        # one look at each document: its length and where the query's terms stand
        per_field = field_tokens(df, fields, key)
        n_terms = F.array(*[F.array_contains("toks", t).cast("int") for t in distinct])
        stats = per_field.groupBy("field").agg(
            F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"),
            *[F.sum(n_terms[i]).alias(f"df{i}") for i in range(len(distinct))],
        )
        hits = phrase_starts(per_field, terms, key)
    idf = sum([
        F.log(1 + (F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)) for i in range(len(distinct))
    ], F.lit(0.0))
    stats = stats.select("field", "avg_len", idf.alias("idf"))  # one row per field
    tf = F.col("freq") * (K1 + 1) / (F.col("freq") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = hits.join(F.broadcast(stats), "field").select(key, (F.col("idf") * tf).alias("s"))
    return scored.groupBy(key).agg(F.sum("s").alias("score"))


def phrase_starts(per_field: DataFrame, terms: list[str], key: str) -> DataFrame:
    """field, post_id, len, freq of the phrase, counted inside each row: a start
    is a position of the first term at which the next tokens are the other terms."""
    n = len(terms)
    phrase = F.array(*[F.lit(t) for t in terms])
    last = F.size("toks") - n
    starts = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                      lambda i: (F.get(F.col("toks"), i) == terms[0]) & (F.slice(F.col("toks"), i + 1, n) == phrase))
    found = per_field.where((last >= 0) & F.array_contains("toks", terms[0]))
    return found.select(key, "field", "len", F.size(starts).alias("freq")).where(F.col("freq") > 0)


def sentiment_filter(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Any of the chosen labels; none chosen is no filter."""
    return df.where(F.col("sentiment_label").isin(labels)) if labels else df


def date_range_filter(df: DataFrame, date_from: str = "", date_to: str = "") -> DataFrame:
    """Days inclusive on both ends; an empty bound is open."""
    if date_from:
        df = df.where(F.col("created_at") >= F.lit(date_from).cast("timestamp"))
    if date_to:
        df = df.where(F.col("created_at") < F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp"))
    return df


def sort_columns(sort: str = "relevance", key: str = "post_id") -> list[Column]:
    """Sort expressions; an unknown name is relevance. The key breaks ties."""
    chosen = SORTS.get(sort, SORTS["relevance"])
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in chosen] + [F.col(key).asc()]


def paginate(df: DataFrame, order: list[Column], start: int = 0, rows: int = 10) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(rows)


def num_found(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("num_found"))


def sentiment_facets(matches: DataFrame) -> DataFrame:
    """Rows per label over the whole match set; labels without rows do not show."""
    return matches.where(F.col("sentiment_label").isNotNull()).groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n"))


def facet_percentages(facets: DataFrame) -> DataFrame:
    from pyspark.sql.window import Window as W

    total = F.sum("n").over(W.partitionBy(F.lit(1)))  # at most one row per label
    return facets.select("sentiment_label", "n", F.round(ratio(F.col("n") * 100.0, total), 1).alias("pct"))


def highlight(text: Column | str, query: str) -> Column:
    """<mark> around every hit of the phrase in the whole text; without a hit the
    first 200 characters and dots."""
    col = F.col(text) if isinstance(text, str) else text
    plain = F.concat(F.substring(col, 1, 200), F.lit("..."))
    terms = query_terms(query)
    if query == "*" or not terms:
        return plain
    gap = f"[^{WORD_BODY}]+"
    phrase = gap.join(terms)
    edge = f"(^|[^{WORD_BODY}])"
    marked = F.regexp_replace(col, f"(?i){edge}({phrase})(?=[^{WORD_BODY}]|$)", "$1<mark>$2</mark>")
    return F.when(marked != col, marked).otherwise(plain)


@dataclass
class SearchResult:
    """Frames of one search."""

    docs: DataFrame
    num_found: DataFrame
    facets: DataFrame


def match_set(df: DataFrame, query: str = "*", sentiment: list[str] | None = None,
              date_from: str = "", date_to: str = "", key: str = "post_id", index: Index | None = None) -> DataFrame:
    """All rows of the filtered match set with their score, unsorted."""
    filtered = date_range_filter(sentiment_filter(df, sentiment), date_from, date_to)
    if query == "*":
        return filtered.withColumn("score", F.lit(1.0))
    # statistics belong to the whole table, the filter to the result
    return filtered.join(relevance_scores(df, query, key=key, index=index), key)


MAX_PAGE = 10_000


def search(df: DataFrame, query: str = "*", sentiment: list[str] | None = None, date_from: str = "",
           date_to: str = "", sort: str = "relevance", start: int = 0, rows: int = 10,
           key: str = "post_id", index: Index | None = None) -> SearchResult:
    """Page, count and facets of one query. The narrow match set is written to the
    shared folder and serves all three; texts are fetched for the page only, by the
    at most `rows` keys on it."""
    if rows > MAX_PAGE:
        raise ValueError(f"a page has at most {MAX_PAGE} rows")
    matches = cut_lineage(match_set(df, query, sentiment, date_from, date_to, key, index).select(
        key, "score", "likes", "reposts", "created_at", "sentiment_label"))
    page = cut_lineage(paginate(matches, sort_columns(sort, key), start, rows))
    keys = [r[0] for r in page.select(key).collect()]
    texts = df.where(F.col(key).isin(keys)).select(key, "platform", "author", "text", "cleaned_text")
    docs = texts.join(F.broadcast(page), key).withColumn("highlighted_text", highlight("text", query))
    return SearchResult(docs.orderBy(*sort_columns(sort, key)), num_found(matches), sentiment_facets(matches))

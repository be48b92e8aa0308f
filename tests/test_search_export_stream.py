"""Search, sinks and streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from voxtide.operators import export, search
from voxtide.session import shared_dir
from voxtide.sources import readers, tables
from voxtide.streaming import jobs as streams

ROWS = [
    ("a", "AI tools are great. AI tools!", None, "positive", 5, "2026-01-01 10:00:00"),
    ("b", "tools for AI", "ai tool", "negative", 9, "2026-01-02 23:59:59"),
    ("c", "nothing here", "ai tools inside", None, 1, "2026-01-03 00:00:00"),
    ("d", "ai, tools and more ai", "", "positive", 7, "2026-01-04 00:00:00"),
]


def table(spark):
    df = spark.createDataFrame(ROWS, "post_id string, text string, cleaned_text string, sentiment_label string, likes long, ts string")
    return df.select("post_id", "text", "cleaned_text", "sentiment_label", "likes", F.lit(0).cast("long").alias("reposts"),
                     F.col("ts").cast("timestamp").alias("created_at"), F.lit("bluesky").alias("platform"), F.lit("me").alias("author"))


def ids(df):
    return sorted(r["post_id"] for r in df.collect())


def test_phrase(spark):
    df = table(spark)
    assert ids(search.phrase_match(df, "AI tools")) == ["a", "c", "d"]
    assert ids(search.phrase_match(df, "*")) == ["a", "b", "c", "d"]
    index = search.Index(shared_dir(spark, "index"), 4)
    search.write_index(df, index.path, term_buckets=4)
    for q in ("AI tools", "tools", "ai", "tools for ai", "ai ai", "!!!", ""):
        assert ids(search.phrase_match(df, q)) == ids(search.phrase_match(df, q, index=index)), q
        plain, read = ({r["post_id"]: round(r["score"], 9) for r in search.relevance_scores(df, q, index=i).collect()} for i in (None, index))
        assert plain == read, q
    assert ids(search.phrase_match(df, "!!!")) == [] and search.search(df, "!!!").num_found.first()[0] == 0


def test_search_reads_the_index_only(spark):
    df = table(spark)
    index = search.Index(shared_dir(spark, "index"), 4)
    search.write_index(df, index.path, term_buckets=4)
    plan = search.relevance_scores(df, "ai tools", index=index)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters: (.*?), ReadSchema: struct<(.*?)>", plan)
    assert len([s for s in scans if "bucket" in s[0] and "In(term" in s[1]]) == 2
    assert len(scans) == 3 and not any("text" in columns for *_, columns in scans)


def test_phrases_match_a_scan(spark):
    rng = random.Random(1)
    docs = [(str(i), " ".join(rng.choice("aabc") for _ in range(rng.randrange(0, 12)))) for i in range(200)]
    df = spark.createDataFrame(docs, "post_id string, text string").withColumn("cleaned_text", F.lit(None).cast("string"))
    index = search.Index(shared_dir(spark, "index"), 4)
    search.write_index(df, index.path, term_buckets=4)
    for q in ("a", "a a", "a b a", "a a a", "c b"):
        want = sorted(i for i, t in docs if re.search(rf"(?:^| ){q}(?: |$)", t))
        assert ids(search.phrase_match(df, q)) == want
        assert ids(search.phrase_match(df, q, index=index)) == want


def test_postings_are_made_where_documents_lie(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))
    rows = [(rng.choice([f"k{i}", f"k{i}", "twice", None]), text(), rng.choice([None, "", text()])) for i in range(60)]
    schema = "post_id string, text string, cleaned_text string"
    want, docs_of = {}, {}
    for k, *texts in rows:
        for field, t in zip(search.FIELDS, texts):
            for pos, term in enumerate((t or "").split()):
                want.setdefault((field, term, k), []).append(pos)
                docs_of.setdefault((field, term), set()).update({k} - {None})
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = {(r.field, r.term, r.post_id): (r.positions, r.tf) for r in search.index_documents(df).collect()}
    assert got == {k: (sorted(v), len(v)) for k, v in want.items()}
    index = search.Index(shared_dir(spark, "index"), 4)
    search.write_index(df, index.path, term_buckets=4)
    counts = {(r.field, r.term): r.n_docs for r in index.read(spark, "terms").collect()}
    assert counts == {k: len(v) for k, v in docs_of.items()}
    read = {}
    for r in index.occurrences(spark, list("abcd")).collect():
        read.setdefault((r.field, r.term, r.post_id), []).append(r.pos)
    assert {k: sorted(v) for k, v in read.items()} == {k: sorted(v) for k, v in want.items()}
    # keys of their own: no posting is shuffled
    own = search.index_documents(spark.createDataFrame([("a", "x y x", None), ("b", "y", "x")], schema))
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString() and own.count() == 4


def test_search_call(spark):
    result = search.search(table(spark), "ai tools", sort="likes", rows=2)
    assert [r["post_id"] for r in result.docs.collect()] == ["d", "a"]
    assert result.num_found.first()[0] == 3
    assert {r["sentiment_label"]: r["n"] for r in result.facets.collect()} == {"positive": 2}
    ranked = [r["post_id"] for r in search.search(table(spark), "ai tools", sort="nonsense").docs.collect()]
    assert set(ranked) == {"a", "c", "d"} and ranked[0] in ("a", "c")


def test_filters(spark):
    df = table(spark)
    assert ids(search.date_range_filter(df, "2026-01-02", "2026-01-03")) == ["b", "c"]
    assert ids(search.date_range_filter(df, "", "2026-01-02")) == ["a", "b"]
    assert ids(search.sentiment_filter(df, [])) == ["a", "b", "c", "d"]
    assert ids(search.sentiment_filter(df, ["negative"])) == ["b"]


def test_highlight(spark):
    df = spark.createDataFrame([("The AI Tools rule; ai tools, AI-tools!",), ("x" * 300,), ("mai tools",)], "t string")
    got = [r[0] for r in df.select(search.highlight("t", "ai tools")).collect()]
    assert got == ["The <mark>AI Tools</mark> rule; <mark>ai tools</mark>, <mark>AI-tools</mark>!", "x" * 200 + "...", "mai tools..."]


def stored_like(spark):
    return tables.stored(spark, "/root/testdata/sf0.001")


def test_export_columns_and_empty_csv(spark):
    df = stored_like(spark)
    full, short = export.export_projection(df), export.export_projection(df, clean_text_only=True)
    assert len(full.columns) == 18 and len(short.columns) == 16 and full.columns[:4] == ["platform", "post_id", "author", "text"]
    path = shared_dir(spark, "csv")
    export.export_csv(full.where("false"), path)
    assert spark.read.text(path).first()[0] == ",".join(full.columns)
    path = shared_dir(spark, "csv")
    export.export_csv(full, path)
    back = readers.read_records_csv(spark, path)
    assert back.count() == df.count() and {r[0] for r in back.select("is_reply").distinct().collect()} == {"True", "False"}
    with pytest.raises(ValueError):
        export.replace_records_csv(back, path, path + "/")


def scores_of(spark, df, phrase, index=None):
    return {r.post_id: round(r.score, 9) for r in search.relevance_scores(df, phrase, index=index).collect()}


def test_index_follows_the_table(spark, monkeypatch):
    path, folder = shared_dir(spark, "table"), shared_dir(spark, "index")
    schema = "post_id string, text string, cleaned_text string"
    rows = [(f"p{i}", "a red fox " * (i % 4) + "and more", "red fox" if i % 3 else None) for i in range(40)]
    view = lambda d: d.withColumn("text", F.upper("text"))

    def land(part, mode="append"):
        spark.createDataFrame(part, schema).coalesce(1).write.mode(mode).parquet(path)
        df = spark.read.schema(schema).parquet(path)
        index = search.refresh_index(df, view, folder, term_buckets=4)
        for phrase in ("red fox", "fox", "no such words"):
            assert scores_of(spark, df, phrase, index) == pytest.approx(scores_of(spark, view(df), phrase))
        return index

    assert len(land(rows[:20]).segments) == 1
    assert len(land(rows[20:30]).segments) == 2
    three = land(rows[30:])
    assert len(three.segments) == 3
    df = spark.read.schema(schema).parquet(path)
    assert search.refresh_index(df, view, folder, term_buckets=4) == three  # nothing new, nothing written
    monkeypatch.setattr(search, "MAX_SEGMENTS", 3)
    assert len(land([("q", "a red fox", None)]).segments) == 1
    changed = land(rows[:5], "overwrite")
    df = spark.read.schema(schema).parquet(path)
    assert len(changed.segments) == 1 and len(scores_of(spark, df, "fox", changed)) == 4
    assert len(search.refresh_index(df, view, folder, term_buckets=8).segments) == 1
    gone = shared_dir(spark, "index")  # a folder that does not exist
    assert scores_of(spark, df, "fox", search.refresh_index(df, view, gone, term_buckets=4))


def test_json_array_per_file(spark):
    import json
    path = shared_dir(spark, "json")
    df = spark.range(5).select("id", F.lit(None).cast("string").alias("missing")).repartition(2)
    export.export_json(df, path)
    files = [r[1] for r in spark.sparkContext.wholeTextFiles(path).collect()]
    objects = [o for f in files for o in json.loads(f)]
    assert sorted(o["id"] for o in objects) == [0, 1, 2, 3, 4] and all(o["missing"] is None for o in objects)


def test_json_arrays_are_bounded(spark):
    import json

    def written(df, **limits):
        path = shared_dir(spark, "json")
        export.export_json(df, path, **limits)
        return [r.value for r in spark.read.text(path).collect()]

    word = F.concat(F.lit('"é\\'), F.col("id").cast("string"), F.lit(" "))
    df = spark.range(0, 300, 1, 3).select("id", F.repeat(word, (F.col("id") % 50).cast("int")).alias("text"), F.lit(None).cast("int").alias("none"))
    files = written(df, max_bytes=2000)
    alone = max(len(json.dumps(r.asDict(), ensure_ascii=False, separators=(",", ":")).encode()) for r in df.collect())
    assert alone < 2000 and all(len(f.encode()) <= 2000 for f in files)
    assert sorted((o["id"], o["text"], o["none"]) for f in files for o in json.loads(f)) == sorted(map(tuple, df.collect()))
    assert [len(json.loads(f)) for f in written(df.coalesce(1), rows_per_array=120)] == [120, 120, 60]
    long = written(spark.range(4).select(F.repeat(F.lit("w "), 20_000).alias("t")), max_bytes=50_000)
    assert len(long) == 4 and all(len(f) < 50_000 for f in long)
    assert [len(json.loads(f)) for f in written(df.where("id < 3").coalesce(1), max_bytes=1)] == [1, 1, 1]
    assert written(df.where("false")) == ["[]"]


def test_json_arrays_are_held_once():
    import json
    import tracemalloc

    import pyarrow as pa

    text, most = "\U0001F600 words " * 1000, 4 << 20
    batch = pa.record_batch({"value": [json.dumps({"i": i, "t": text}, ensure_ascii=False) for i in range(1000)]})
    got = []
    tracemalloc.start()
    for out in export.json_arrays(iter([batch]), 100_000, most):
        assert out.num_rows == 1 and out["value"].nbytes < most + 64
        got.append(bytes(memoryview(out["value"][0].as_buffer())[:9]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 3 and peak < 3 * most
    assert [r["i"] for out in export.json_arrays(iter([batch]), 300, 1 << 30) for r in json.loads(out["value"][0].as_py())] == list(range(1000))


def test_stream_first_wins_and_restart(spark):
    landed, stored, check = (shared_dir(spark, n) for n in ("landed", "stored", "check"))
    schema = "ingest_seq long, post_id string, text string"
    spark.createDataFrame([(1, "a", "first"), (2, "b", "b"), (3, "a", "again")], schema).coalesce(1).write.parquet(landed)
    stream = lambda: streams.file_stream(spark, landed, spark.createDataFrame([], schema).schema)
    streams.run_to_end(streams.dedup_ingest(stream(), stored, check))
    spark.createDataFrame([(4, "b", "late"), (5, "c", "c")], schema).write.mode("append").parquet(landed)
    streams.run_to_end(streams.dedup_ingest(stream(), stored, check))
    got = {r["post_id"]: r["text"] for r in spark.read.schema(schema).parquet(stored).collect()}
    assert got == {"a": "first", "b": "b", "c": "c"}


def test_stream_keys_beyond_the_window(spark):
    landed, stored, check = (shared_dir(spark, n) for n in ("landed", "stored", "check"))
    schema, day = "ingest_seq long, post_id string, text string, at timestamp, x double", ["2026-01-01"]
    at = "timestamp'2026-01-01 10:00:00.123456'"
    empty = spark.createDataFrame([], schema).schema

    def land(rows):
        spark.createDataFrame(rows, "ingest_seq long, post_id string, text string").selectExpr("*", f"{at} at", "if(ingest_seq = 1, double('NaN'), 0.1) x").write.mode("append").parquet(landed)
        streams.run_to_end(streams.dedup_ingest(streams.file_stream(spark, landed, empty, 8), stored, check, days=0, today=lambda: day[0]))

    land([(1, "a", "first"), (2, "b", "b"), (0, None, "no key"), (3, "a", "again")])
    day[0] = "2026-01-05"
    land([(4, "c", "c"), (5, "a", "late")])
    day[0] = "2026-01-09"
    land([(6, "b", "late"), (7, "c", "late"), (8, "d", None)])
    got = {r.post_id: (r.text, str(r["at"]), str(r.x)) for r in spark.read.schema(empty).parquet(stored).collect()}
    when = "2026-01-01 10:00:00.123456"
    assert got == {"a": ("first", when, "nan"), "b": ("b", when, "0.1"), "c": ("c", when, "0.1"), "d": (None, when, "0.1")}
    # a batch reads the folders of its own buckets, of days that have left the window
    old = streams.older_keys(spark, f"{stored}_keys", "2026-01-06", 99, [5])
    assert all("bucket=5/" in f or "bucket=5" in f for f in old.inputFiles()) or not old.count()
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert streams.older_keys(spark, stored + "-none", "2026-01-06", 99, [5]) is None


def test_stream_cost_does_not_follow_what_is_stored(spark):
    """Ten batches of as many rows: in the window no stored key is read, and the store
    is asked about the rows of the batch alone."""
    landed, stored, check = (shared_dir(spark, n) for n in ("landed", "stored", "check"))
    for b in range(10):
        spark.range(b * 40, b * 40 + 50).selectExpr("id ingest_seq", "concat('k', id) post_id", "'t' text").coalesce(1).write.mode("append").parquet(landed)
    query = streams.dedup_ingest(streams.file_stream(spark, landed, spark.createDataFrame([], "ingest_seq long, post_id string, text string").schema), stored, check)
    streams.run_to_end(query)
    batches = [p for p in query.recentProgress if p.numInputRows]
    assert len(batches) == 10 and {p.numInputRows for p in batches} == {50}
    assert all(p.stateOperators[0].numRowsUpdated <= 50 for p in batches)
    assert batches[-1].stateOperators[0].numRowsTotal == 410
    assert spark.read.schema("ingest_seq long, post_id string").parquet(stored).count() == 410
    assert streams.older_keys(spark, f"{stored}_keys", "2020-01-01", 99, list(range(streams.BUCKETS))).count() == 0


def test_stream_keys_are_looked_up_without_python(spark):
    """One group of a few rows per key cost milliseconds of Python; the first row of a
    batch is the first of all its files, whole, with nested values and nulls."""
    landed, stored, check = (shared_dir(spark, n) for n in ("landed", "stored", "check"))
    rows = spark.range(3000).selectExpr("id ingest_seq", "concat('k', id % 500) post_id", "if(id % 7 = 0, null, concat('t', id)) text",
                                        "map('a', array(id, null)) m", "cast(id / 8 as decimal(20, 3)) d")
    for low in (2000, 0, 1000):
        rows.where(f"ingest_seq between {low} and {low + 999}").repartition(2).write.mode("append").parquet(landed)
    query = streams.dedup_ingest(streams.file_stream(spark, landed, rows.schema, 99), stored, check)
    streams.run_to_end(query)
    assert [p.stateOperators[0].operatorName for p in query.recentProgress][0] == "dedupeWithinWatermark"
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) == 500
    got = spark.read.schema(rows.schema).parquet(stored)
    assert sorted(map(str, got.select(rows.columns).collect())) == sorted(map(str, rows.where("ingest_seq < 500").collect()))


def test_stream_watermark_variant(spark):
    landed, out, check = (shared_dir(spark, n) for n in ("landed", "out", "check"))
    rows = [(i % 5, f"2026-01-01 00:00:{i:02d}") for i in range(20)]
    df = spark.createDataFrame(rows, "k long, ts string").select(F.col("k").cast("string").alias("post_id"), F.col("ts").cast("timestamp").alias("created_at"))
    df.write.parquet(landed)
    stream = streams.dedup_within_watermark(streams.file_stream(spark, landed, df.schema))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    streams.run_to_end(q)
    assert spark.read.parquet(out).count() == 5

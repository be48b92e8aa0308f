"""Named queries of this package and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.llm import sql
from voxtide.llm.decontaminate import find_items
from voxtide.llm.license_scan import license_scan
from voxtide.llm.line_dedup import line_dedup
from voxtide.llm.merkle import fold, merkle_proofs, proof_digest
from voxtide.llm.packing import pack
from voxtide.llm.quality_rules import quality_rules
from voxtide.llm.runs import find_runs
from voxtide.llm.sharding import hilbert_shards
from voxtide.llm.simhash_dedup import simhash_dedup
from voxtide.llm.substring_dedup import substring_dedup
from voxtide.llm.suffix_dedup import suffix_dedup
from voxtide.llm.token_counts import prefix_counts
from voxtide.llm.toxicity import toxic_sentences, train

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), min_words=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"), min_bytes=50)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), min_run=3, min_words=50)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096, with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def crc_of(id_col: str) -> F.Column:
    return F.crc32(F.col(id_col).cast("string"))


def op11_toxic_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.where(crc_of("doc_id") % 5 != 0))
    out = toxic_sentences(docs, *model)
    return out.select("doc_id", F.coalesce(crc_of("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      F.size("sentences").cast("long").alias("n_offending"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where in one of ten texts the words from a place on repeat."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    h = crc_of("doc_id")
    # only the texts that change are split here
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("ws"))
    rows = rows.withColumn("n", F.size("ws")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    head, unit = F.slice("ws", F.lit(1), F.col("a")), F.slice("ws", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(head, tail), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                      F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc_of("doc_id") % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    out = merkle_proofs(docs, altered={"text": tampered})
    folded = fold(F.coalesce("altered_leaf", "leaf"), "path")
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_substring_dedup, op2_quality_rules, op3_suffix_array_dedup, op4_decontamination, op5_simhash_dedup, op6_hilbert_sharding,
    op7_line_dedup, op8_license_scan, op9_mixture_packing, op10_token_counts, op11_toxic_sentences, op12_periodic_runs, op13_merkle_manifest)}

ORACLES: dict[str, str] = {"op1_substring_dedup": sql.OP1, "op3_suffix_array_dedup": sql.OP3, "op7_line_dedup": sql.OP7,
                           "op12_periodic_runs": sql.OP12, "op13_merkle_manifest": sql.OP13}

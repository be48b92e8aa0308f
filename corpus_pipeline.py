"""Documents to training sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.llm.decontaminate import drop_contaminated
from voxtide.llm.line_dedup import line_dedup
from voxtide.llm.packing import pack
from voxtide.llm.quality_rules import keep_good
from voxtide.llm.simhash_dedup import keep_one
from voxtide.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or a certified one go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of 3 lines, or of fewer with 50 words, are cut out of the
    texts; every document stays, one that held nothing else with an empty text. n_chars follows the text."""
    columns = docs.columns
    out = line_dedup(docs, min_run=3, carry=tuple(columns), min_words=50)
    named = out.select(F.col("kept_text"), F.col("n_removed"), *[F.col(f"c{i}").alias(f"_{c}") for i, c in enumerate(columns)])
    cut = F.col("n_removed") > 0
    change = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("_text")), "n_chars": F.when(cut, F.char_length("kept_text").cast("long")).otherwise(F.col("_n_chars"))}
    return named.select(*[change.get(c, F.col(f"_{c}")).cast(docs.schema[c].dataType).alias(c) for c in columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id."""
    return keep_one(docs, shingle=4, distance=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 4096 tokens mixed by source; one row per piece."""
    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, length=4096, with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("decontamination", decontaminate), ("packing", packing)]

#: Fingerprints, certified cutoffs and token ids cannot be said in SQL; the tests
#: hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; what each keeps is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

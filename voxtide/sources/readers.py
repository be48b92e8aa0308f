"""Readers of landed data. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.schema import COMMENT, OPINION, RAW_POST


def read_opinions(spark: SparkSession, path: str) -> DataFrame:
    """The post table; columns absent from older files come back null."""
    return spark.read.schema(OPINION).option("mergeSchema", "true").parquet(path)


def read_raw_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_POST).json(path)


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Line-JSON comment records."""
    return spark.read.schema(COMMENT).json(path)


def read_records_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: every value a string, empty cells '', quoted line breaks kept."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"', encoding="UTF-8")
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])

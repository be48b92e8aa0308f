"""The "only what is missing" pattern: pending rows, updates by key, resets."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtide.operators.skew import first_per_key
from voxtide.session import shared_dir

TASKS = ("subjectivity", "polarity")
RESETS = {
    "sentiment": ["sentiment_score", "sentiment_label"],
    "relevance": ["relevance_score", "relevance_label"],
    "clean": ["cleaned_text", "clean_status"],
    "subjectivity": ["subjectivity_label"],
    "polarity": ["polarity_label"],
}


def pending_sentiment(df: DataFrame) -> DataFrame:
    return df.where(F.col("sentiment_score").isNull())


def pending_clean(df: DataFrame) -> DataFrame:
    return df.where(F.col("clean_status").isNull())


def pending_relevance(df: DataFrame) -> DataFrame:
    return df.where(F.col("relevance_label").isNull())


def pending_classification(df: DataFrame, task: str, platform: str | None = None) -> DataFrame:
    if task not in TASKS:
        raise ValueError(f"unknown task: {task}")
    out = df.where(F.col(f"{task}_label").isNull())
    return out if platform in (None, "all") else out.where(F.col("platform") == platform)


def apply_updates(base: DataFrame, updates: DataFrame, columns: list[str], key: str = "post_id", order: str | None = None) -> DataFrame:
    """base with `columns` replaced for the keys in updates.

    Of several updates of a key the last by `order` wins; without an order the
    largest by the updated columns does, so that no row multiplies.

    A matched flag decides, not coalesce: an update may set a null on purpose.
    Keys that base does not hold are ignored.
    """
    updates = first_per_key(updates, [key], [F.desc(c) for c in ([order] if order else columns)])
    new = updates.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_matched"))
    joined = base.join(new, key, "left")
    return joined.select(*[
        F.when(F.col("_matched"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
        for c in base.columns
    ])


@dataclass(frozen=True)
class PostStore:
    """A post table and its labels as tables bucketed alike by key.

    The posts, with their texts, are written once. What a labelling step says lies in a
    narrow table of its own (key and labels), which alone is rewritten by the step.
    Reading joins bucket with bucket: no row is shuffled, texts least of all.
    """
    key: str
    buckets: int
    posts: str
    columns: tuple[str, ...]
    labels: dict[tuple[str, ...], str] = field(default_factory=dict)


def _write_bucketed(df: DataFrame, key: str, buckets: int) -> str:
    name = f"voxtide_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key).write.format("parquet").option("path", shared_dir(df.sparkSession, "bucketed"))
    rows.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return name


def open_store(df: DataFrame, key: str = "post_id", buckets: int | None = None) -> PostStore:
    """df written as a store. `key` must be unique; choose the buckets so that one holds
    some hundred megabytes of texts (default: the number of shuffle partitions)."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return PostStore(key, n, _write_bucketed(df, key, n), tuple(df.columns))


def put_labels(spark: SparkSession, store: PostStore, updates: DataFrame, columns: list[str], order: str | None = None) -> PostStore:
    """The store with `columns` replaced for the keys in updates; rules as in
    `apply_updates`. Only the step's own narrow table is read and written. Columns that
    several steps write must come as the same list every time."""
    own = tuple(columns)
    for other in store.labels:
        if other != own and set(other) & set(own):
            raise ValueError(f"columns {own} overlap with those of another step: {other}")
    new = first_per_key(updates, [store.key], [F.desc(c) for c in ([order] if order else columns)]).select(store.key, *columns).where(F.col(store.key).isNotNull())
    if own in store.labels:
        new = spark.table(store.labels[own]).join(new.select(store.key), store.key, "left_anti").unionByName(new)
    return replace(store, labels={**store.labels, own: _write_bucketed(new, store.key, store.buckets)})


def read_store(spark: SparkSession, store: PostStore) -> DataFrame:
    """The post table with every step's labels in place."""
    out = spark.table(store.posts)
    for columns, name in store.labels.items():
        # a bucketed table is scanned bucket by bucket; a matched key decides, not coalesce
        labels = spark.table(name).select(F.col(store.key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
        out = out.join(labels.hint("merge"), F.col(store.key) == F.col("_key"), "left").select(*[
            F.when(F.col("_key").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in store.columns])
    return out


def drop_store(spark: SparkSession, store: PostStore) -> None:
    """Forget the store's tables; their files go with the shared folder."""
    for name in [store.posts, *store.labels.values()]:
        spark.sql(f"drop table if exists {name}")


def reset_columns(df: DataFrame, step: str) -> DataFrame:
    """Null the columns of a step, so that every row is pending again."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.lit(None).cast(types[c]) for c in RESETS[step]})


def count_by_platform(df: DataFrame) -> DataFrame:
    return df.groupBy("platform").agg(F.count(F.lit(1)).alias("n"))

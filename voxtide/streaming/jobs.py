"""The two incremental patterns as Structured Streaming jobs.

Both write every micro-batch to a folder named after its id, replacing what an
earlier attempt of the same batch left there, so a batch that is run again after
a lost executor or driver leaves the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from voxtide.session import cut_lineage


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


BUCKETS = 64
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups that the rows of a micro-batch are dealt into to find the first of each key.
PARTS = 1024


def _packed(stream: DataFrame, key: str, order: str) -> DataFrame:
    """_key, _order and the whole row as _row, the first row of every key of a micro-batch.

    Rows are trimmed in every Arrow batch before they are shuffled, so a key that floods
    the stream does not travel whole. They meet in PARTS groups by the key's hash: a group
    holds that part of one micro-batch, however many keys there are."""
    def firsts(rows: pa.Table) -> pa.Table:
        at = pc.sort_indices(rows, sort_keys=[("_key", "ascending"), ("_order", "ascending")])
        keys = rows.column("_key").take(at)
        new = np.ones(len(at), bool)
        if len(at) > 1:
            new[1:] = np.asarray(pc.not_equal(keys[1:], keys[:-1]))
        return rows.take(at.filter(pa.array(new)))

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from firsts(pa.Table.from_batches([batch])).to_batches()

    keyed = stream.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_key"), F.col(order).cast("long").alias("_order"), F.struct(*stream.columns).alias("_row"))
    part = F.pmod(F.xxhash64("_key"), F.lit(PARTS))
    return keyed.mapInArrow(trim, keyed.schema).groupBy(part).applyInArrow(firsts, keyed.schema)


def first_in_window(stream: DataFrame, key: str = "post_id", order: str = "ingest_seq", days: int = 7) -> DataFrame:
    """The first row by `order` of every key that the state store does not hold.

    The store holds the keys first seen in the last `days` of processing time and nothing
    else: a lookup costs the same however many rows are stored, and what the store keeps
    is bounded by the window. Keys are looked up by Spark itself, without Python."""
    # a key leaves the store when the watermark, one delay behind the time of arrival, is
    # one delay past the key; no row is ever late
    arriving = _packed(stream, key, order).withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", f"{days * 12} hours")
    return arriving.dropDuplicatesWithinWatermark(["_key"]).select("_key", "_row")


def older_keys(spark: SparkSession, path: str, before: str, batch: int, buckets: list[int]) -> DataFrame | None:
    """Keys stored on days before `before` by earlier batches, those of the given
    buckets; None if there are none. Folders name day, batch and bucket, so only
    those of the buckets asked for are listed for reading."""
    schema = "_key string, day string, batch long, bucket int"
    try:
        kept = spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as error:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return kept.where((F.col("day") < before) & (F.col("batch") < batch) & F.col("bucket").isin(buckets)).select("_key", "bucket")


def dedup_ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "post_id", order: str = "ingest_seq", days: int = 7,
                 today: Callable[[], str] = lambda: date.today().isoformat()) -> StreamingQuery:
    """First-wins ingest: the earliest row of a key in a micro-batch is appended unless
    an earlier batch has stored the key. Rows without a key are not stored.

    Keys of the last `days` are in the state store (RocksDB, unless the session names
    another), so in the window a batch costs what it brings, not what is stored. Keys
    that have left the window are found in a store beside the rows, `path`_keys, by day
    and one of BUCKETS hash buckets: a batch reads the buckets that its own new keys
    fall into, of days that have left the window only. Days are counted one more than
    the state store keeps them, so no key is in neither.

    A batch that is run again replaces its folders; the state store goes back to the
    batch before, so the same rows come out.
    """
    spark = stream.sparkSession
    keys = f"{path}_keys"
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, now = batch.sparkSession, today()
        bucket = F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int")
        found = cut_lineage(batch.withColumn("bucket", bucket))
        left = (date.fromisoformat(now) - timedelta(days=days - 1)).isoformat()
        touched = [r.bucket for r in found.select("bucket").distinct().collect()]  # BUCKETS at most
        old = older_keys(spark, keys, left, batch_id, touched)
        new = found if old is None else found.join(old, ["_key", "bucket"], "left_anti")
        new.select("_row.*").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        found.select("_key", "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{keys}/day={now}/batch={batch_id}")

    return first_in_window(stream, key, order, days).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedup_within_watermark(stream: DataFrame, event_time: str = "created_at", delay: str = "7 days",
                           key: str = "post_id") -> DataFrame:
    """Bounded-state variant for append sinks: drops repeats of a key that arrive
    within the watermark. Which copy stays within one batch is not defined."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def annotate(stream: DataFrame, label: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Label rows as they arrive with any batch transformation of this library."""

    def write(batch: DataFrame, batch_id: int) -> None:
        label(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()

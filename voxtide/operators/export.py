"""Filtered export and sinks. Every sink writes a new folder and refuses the
path it reads from; a table is replaced by pointing readers at the new folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.functions.text import blank_or
from voxtide.operators.relevance import relevant_only as only_relevant
from voxtide.schema import EXPORT_COLUMNS

REJECTED = ["bot", "too_short", "duplicate"]


def export_filter(df: DataFrame, platform: str = "all", sentiment: str = "all", relevant_only: bool = False,
                  exclude_rejected: bool = False, clean_text_only: bool = False) -> DataFrame:
    """Rows to export; rows without a status or relevance label stay."""
    if platform != "all":
        df = df.where(F.col("platform") == platform)
    if sentiment != "all":
        df = df.where(F.col("sentiment_label") == sentiment)
    if relevant_only:
        df = only_relevant(df)
    if exclude_rejected or clean_text_only:
        df = df.where(~F.coalesce(F.col("clean_status").isin(REJECTED), F.lit(False)))
    return df


def iso_time(c: Column | str) -> Column:
    """Timestamps as ISO-8601 text in UTC, fractions only where there are any."""
    c = F.to_utc_timestamp(F.col(c) if isinstance(c, str) else c, F.current_timezone())
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(c, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def export_projection(df: DataFrame, clean_text_only: bool = False) -> DataFrame:
    """The 18 export columns in order; 16 in clean-text mode, which exports the
    cleaned text as text."""
    cols = [c for c in EXPORT_COLUMNS if not (clean_text_only and c in ("cleaned_text", "clean_status"))]
    out = {c: F.col(c) for c in cols}
    out["created_at"] = iso_time("created_at")
    if clean_text_only:
        out["text"] = blank_or("cleaned_text", "text")
    return df.select(*[v.alias(k) for k, v in out.items()])


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in every file, also for no rows; booleans spelled True/False,
    missing values and empty strings both as empty cells."""
    cells = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "boolean":
            c = F.when(c, "True").when(~c, "False")
        elif kind == "string":
            c = F.nullif(c, F.lit(""))
        cells.append(c.alias(name))
    df.select(*cells).write.csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="",
                                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def export_jsonl(df: DataFrame, path: str) -> None:
    """One object per line, missing values spelled out as null."""
    df.write.option("ignoreNullFields", "false").json(path)


MAX_FILE_BYTES = 64 << 20


def json_arrays(batches: Iterator[pa.RecordBatch], rows_per_array: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The objects of one column put together as arrays, in UTF-8: an array is held once,
    in as many bytes as its file has."""
    part, rows = bytearray(b"["), 0

    def done() -> pa.RecordBatch:
        part.extend(b"]")
        ends = pa.py_buffer(np.array([0, len(part)], np.int32))
        return pa.record_batch({"value": pa.StringArray.from_buffers(1, ends, pa.py_buffer(part))})

    for batch in batches:
        for body in batch.column(0):
            body = memoryview(body.as_buffer())
            if rows and (rows == rows_per_array or len(part) + len(body) + 2 > max_bytes):
                yield done()
                part, rows = bytearray(b"["), 0
            part.extend(b"," if rows else b"")
            part.extend(body)
            rows += 1
    if rows:
        yield done()


def export_json(df: DataFrame, path: str, rows_per_array: int = 100_000, max_bytes: int = MAX_FILE_BYTES) -> None:
    """JSON arrays, each in a file of its own, of at most rows_per_array objects and
    max_bytes bytes (an object that is larger alone has a file to itself). Every task
    cuts its own rows as they come, so nothing is shuffled and a task holds one array
    at most. Missing values are spelled out as null. No rows give one empty array."""
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    lines = df.select(body.alias("value")).mapInArrow(lambda batches: json_arrays(batches, rows_per_array, max_bytes), "value string")
    if df.isEmpty():
        lines = df.sparkSession.createDataFrame([("[]",)], "value string")
    lines.write.option("maxRecordsPerFile", 1).text(path)


def predictions_jsonl(predictions: DataFrame, path: str) -> None:
    export_jsonl(predictions, path)


def replace_records_csv(rows: DataFrame, source: str, target: str) -> str:
    """Write an updated record set next to the one it came from; returns the new path."""
    if target.rstrip("/") == source.rstrip("/"):
        raise ValueError("a record set cannot be overwritten while it is read; write to a new path")
    export_csv(rows, target)
    return target

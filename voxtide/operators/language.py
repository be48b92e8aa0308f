"""Language of texts that carry no hint: character-trigram Naive Bayes.

The model is a vector of BUCKETS weights per language: every trigram of every
text counts, in the bucket that its three code points give; trigrams that share a
bucket share a weight. So the model has one size whatever the corpus, nothing is
left out of the counts, and detection needs no join: each row is scored where it
lies, with numpy on Arrow batches. Log-probabilities are whole thousandths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.functions.text import as_col

BUCKETS = 1 << 14
STEP = 961, 31  # bucket of a, b, c: (961 a + 31 b + c) % BUCKETS


def letters(text: Column | str) -> Column:
    """The lower-cased letters, anything else one space, with a space around."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(as_col(text)), "[^\\p{L}]+", " ")), F.lit(" "))


def trigram_buckets(text: str | None) -> np.ndarray:
    codes = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.int64)
    return (STEP[0] * codes[:-2] + STEP[1] * codes[1:-1] + codes[2:]) % BUCKETS


@dataclass(frozen=True)
class Detector:
    """Weights, BUCKETS x languages."""
    weights: np.ndarray
    languages: list[str]

    def best(self, text: Column | str) -> Column:
        """The best language of a text (the first one on ties), or null where no
        bucket of it is known. Row by row: no shuffle, rows with one key stay apart."""
        weights, names = self.weights, self.languages

        @F.arrow_udf("string")
        def pick(texts: pa.Array) -> pa.Array:
            out = []
            for x in texts:  # one text at a time as a Python string
                votes = weights[trigram_buckets(x.as_py())].sum(axis=0)
                out.append(names[int(votes.argmax())] if votes[0] < 0 else None)
            return pa.array(out, pa.string())

        return pick(letters(text))

    def without_hint(self, text: Column | str, lang: Column | str) -> Column:
        """Detected language where there is no hint; null, and no text handed over, where there is one."""
        return self.best(F.when(as_col(lang).isNull(), as_col(text)))


def language_profile(df: DataFrame, languages: list[str], text: str = "text", lang: str = "lang") -> Detector:
    """Log-probabilities (thousandths, add-one smoothed over the buckets that any
    text has; 0 where none has). All rows with one of the languages count; each task
    sums its rows before the shuffle, and at most BUCKETS rows reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            for name, own in zip(batch["lang"], batch["letters"]):
                found, n = np.unique(trigram_buckets(own.as_py()), return_counts=True)
                sums[languages.index(name.as_py()), found] += n
        used = np.flatnonzero(sums.any(axis=0))
        yield pa.record_batch({"bucket": pa.array(used, pa.int64()), **{f"n{i}": pa.array(sums[i, used]) for i in range(len(languages))}})

    fields = [f"n{i}" for i in range(len(languages))]
    rows = df.where(F.col(lang).isin(languages)).select(F.col(lang).alias("lang"), letters(text).alias("letters"))
    parts = rows.mapInArrow(count, "bucket long, " + ", ".join(f"{f} long" for f in fields))
    counts = np.zeros((BUCKETS, len(languages)), np.int64)
    for r in parts.groupBy("bucket").agg(*[F.sum(f).alias(f) for f in fields]).collect():
        counts[r["bucket"]] = r[1:]
    seen = counts.any(axis=1)
    share = (counts + 1) / np.maximum(counts.sum(axis=0) + seen.sum(), 1)
    return Detector(np.where(seen[:, None], np.round(np.log(share) * 1000), 0).astype(np.int64), languages)


def detect_language(df: DataFrame, detector: Detector, key: str = "post_id", text: str = "text") -> DataFrame:
    """key, detected for every row."""
    return df.select(key, detector.best(text).alias("detected"))


def with_detected(df: DataFrame, detector: Detector, text: str = "text", lang: str = "lang") -> DataFrame:
    """df plus `detected`, null for rows that have a hint."""
    return df.withColumn("detected", detector.without_hint(text, lang))

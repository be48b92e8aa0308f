"""Toxic sentences, learned from labels of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxtide.llm import units as U
from voxtide.llm.quality_rules import _by_bytes
from voxtide.session import cut_lineage

BITS = 18        # features are hashed into 2^BITS weights: what is broadcast is 1 MB
STEMS = (4, 6)   # leading characters of a word that are features beside the word
SPAN = "struct<start: bigint, length: bigint, score: double>"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n\x1e")] = True  # the last stands between two texts


@dataclass(frozen=True)
class Sample:
    """What the model is fitted on: at most `rows` labelled rows of at most
    `row_bytes` each and `bytes` together, those with the least hash of the id."""
    rows: int = 16_384
    row_bytes: int = 1 << 20
    bytes: int = 32 << 20


@dataclass(frozen=True)
class Fit:
    epochs: int = 24
    batch: int = 128    # texts, or a 24th of the sample if that is less
    rate: float = 0.5
    sparse: float = 3e-4  # what every weight loses towards 0, in units of its rate
    rare: int = 3       # features seen less often have no weight
    bias: float = -4.0


@dataclass
class Bags:
    """Texts as bags of sentences, sentences as bags of features."""
    features: np.ndarray   # by sentence
    first: np.ndarray      # feature number at which each sentence begins; sentences hold one at least
    text: np.ndarray       # text of each sentence
    start: np.ndarray      # bytes of each sentence in its text
    end: np.ndarray
    n: int                 # texts


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals in lower case; every character keeps its bytes."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    second = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[second] += 32
    return out


def bags_of(texts) -> Bags:
    """Sentences end at . ! ? and line ends; words are runs of a-z, 0-9 and non-ASCII
    bytes. A word's features are the word and its first STEMS characters."""
    raw, offsets = U.text_bytes(texts, b"\x1e")
    n = len(offsets) - 1
    data = _lowered(raw)
    letter = _LETTER[data]
    edge = np.diff(letter.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    stops = np.append(0, np.cumsum(_STOP[data]))
    points = np.flatnonzero((data & 0xC0) != 0x80)
    nth = np.searchsorted(points, starts)
    values = data.astype(np.uint64) + np.uint64(1)
    keys = [U.span_hashes(values, starts, ends)]
    for k in STEMS:
        cut = np.minimum(points[np.minimum(nth + k, len(points) - 1)], ends) if len(points) else ends
        keys.append(U.mix(U.span_hashes(values, starts, np.maximum(cut, starts)) + np.uint64(k)))
    features = (np.stack(keys, axis=1).reshape(-1) & np.uint64((1 << BITS) - 1)).astype(np.int32)
    sentence = stops[starts]
    new = np.flatnonzero(np.diff(sentence, prepend=-1))
    text = np.searchsorted(offsets, starts[new], side="right") - 1
    last = ends[np.append(new[1:], len(starts)) - 1] if len(new) else new
    return Bags(features, np.append(new, len(starts)) * len(keys), text, starts[new] - offsets[text], last - offsets[text], n)


def joined(parts: list[Bags]) -> Bags:
    """The texts of all parts, one after the other."""
    size = np.cumsum([0, *[len(p.features) for p in parts]])
    texts = np.cumsum([0, *[p.n for p in parts]])
    return Bags(
        np.concatenate([p.features for p in parts]), np.append(np.concatenate([p.first[:-1] + k for p, k in zip(parts, size)]), size[-1]),
        np.concatenate([p.text + k for p, k in zip(parts, texts)]), np.concatenate([p.start for p in parts]), np.concatenate([p.end for p in parts]), int(texts[-1]))


def sentence_scores(bags: Bags, weights: np.ndarray, bias: float) -> np.ndarray:
    """The chance that each sentence is toxic."""
    if not len(bags.text):
        return np.zeros(0)
    z = np.add.reduceat(weights[bags.features], bags.first[:-1]) + bias
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(scores: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """1 - product of (1 - score) over each text's sentences; 0 for a text without any."""
    return -np.expm1(np.bincount(text, weights=np.log1p(-np.minimum(scores, 1 - 1e-12)), minlength=n))


def gradient(scores: np.ndarray, text: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of the log loss of the texts' noisy-or, by each sentence's logit. In a text that
    is not toxic every sentence counts; in a toxic one they share what the product of
    their complements leaves open, so the blame goes to the likeliest."""
    none = np.exp(np.bincount(text, weights=np.log1p(-np.minimum(scores, 1 - 1e-12)), minlength=len(labels)))
    share = np.where(labels > 0, -none / np.maximum(1 - none, 1e-12), 1.0)
    return share[text] * scores


def fit(bags: Bags, labels: np.ndarray, how: Fit = Fit()) -> tuple[np.ndarray, float]:
    """Weights by feature, and the bias: AdaGrad over batches of texts in their order,
    each step followed by one towards 0, so features that only memorise a text lose
    their weight."""
    size = 1 << BITS
    weights, seen = np.zeros(size), np.zeros(size, np.int64)
    for at in range(0, len(bags.features), 1 << 20):
        seen += np.bincount(bags.features[at: at + (1 << 20)], minlength=size)
    common = seen >= how.rare
    grown, bias, bias_grown = np.full(size, 1e-3), how.bias, 1e-3
    batch = max(1, min(how.batch, bags.n // 24))
    edges = np.searchsorted(bags.text, np.arange(0, bags.n + batch, batch))
    for _ in range(how.epochs):
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a == b:
                continue
            part = Bags(bags.features[bags.first[a]: bags.first[b]], bags.first[a: b + 1] - bags.first[a], bags.text[a:b] - k * batch, bags.start, bags.end, batch)
            own = labels[k * batch: (k + 1) * batch]
            slope = gradient(sentence_scores(part, weights, bias), part.text, own) / len(own)
            g = np.bincount(part.features, weights=np.repeat(slope, np.diff(part.first)), minlength=size) * common
            grown += g * g
            rate = how.rate / np.sqrt(grown)
            weights -= rate * g
            weights = np.sign(weights) * np.maximum(np.abs(weights) - how.sparse * rate, 0)
            total = slope.sum()
            bias_grown += total * total
            bias -= how.rate * total / np.sqrt(bias_grown)
    return weights, bias


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: Sample) -> DataFrame:
    """id, text, y of the rows to fit on, and h, a hash of the text. Equal rows count once."""
    id_, place = F.col("id"), F.xxhash64("id")
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(id_.isNotNull() & F.col("y").isNotNull())
    chosen = chosen.groupBy("id").agg(F.max("y").cast("int").alias("y")).orderBy(place, "id").limit(sample.rows)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    mine = cut_lineage(rows.join(F.broadcast(chosen), "id").withColumns({"size": F.octet_length("text"), "h": F.xxhash64("text")}).where(F.col("size") <= sample.row_bytes))
    sizes = mine.groupBy("id", "h").agg(F.min("size").alias("size")).orderBy(place, "h", "id").limit(sample.rows)
    # a window over at most sample.rows rows of numbers
    upto = F.sum("size").over(W.orderBy(place, "h", "id").rowsBetween(W.unboundedPreceding, 0))
    picked = sizes.withColumn("upto", upto).where(F.col("upto") <= sample.bytes).select("id", "h")
    return mine.join(F.broadcast(picked), ["id", "h"]).groupBy("id", "h").agg(F.first("text").alias("text"), F.first("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: Sample = Sample(), how: Fit = Fit()) -> tuple[np.ndarray, float]:
    """Weights and bias from labelled rows: labels of 1 are toxic, 0 not, a null says
    nothing; of several labels of an id the largest counts. Which rows are looked at,
    and how many bytes at most, Sample says; one task fits them, so the driver sees the
    weights alone. Without labelled rows all weights are 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        weights, bias = np.zeros(1 << BITS), how.bias
        if any(b.num_rows for b in parts):
            rows = pa.Table.from_batches(parts).sort_by([("place", "ascending"), ("h", "ascending"), ("id", "ascending")])
            # a slice at a time: what stays are 32-bit features
            bags = joined([bags_of(part["text"]) for batch in rows.to_batches() for part in _by_bytes(batch, 1 << 19)])
            weights, bias = fit(bags, rows["y"].to_numpy(), how)
        yield pa.record_batch({"weights": pa.array([weights.astype("<f4").tobytes()], pa.binary()), "bias": pa.array([float(bias)])})

    rows = sample_of(docs, labels, id_col, text_col, label_col, sample).withColumn("place", F.xxhash64("id"))
    model = cut_lineage(rows.repartition(1).mapInArrow(run, "weights binary, bias double")).first()
    return (np.frombuffer(model["weights"], "<f4"), model["bias"]) if model else (np.zeros(1 << BITS, "<f4"), how.bias)


def toxic_sentences(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The score of every text, and its offending sentences.

    A sentence's score is the chance that it alone makes the text toxic; the text's is
    their noisy-or. Offending are sentences that score `least` or more, or the highest
    one (the first of them) of a text that scores `least` only by all together. One
    pass, no shuffle; the weights are broadcast, 2^BITS numbers whatever the data.

    A null text, or one without words, has no sentence and scores 0. Each row gives one
    row, whatever its id; columns of other names are not read.

    Returns id, n_sentences, score, sentences (start and length in bytes, score).
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, "<f4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.astype(np.float64)
        for batch in batches:
            for part in _by_bytes(batch):
                yield _judge(part, weights, bias, least)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_sentences long, score double, sentences array<{SPAN}>").withColumnRenamed("id", id_col)


def _judge(part: pa.RecordBatch, weights: np.ndarray, bias: float, least: float) -> pa.RecordBatch:
    bags = bags_of(part["text"])
    scores = sentence_scores(bags, weights, bias)
    whole = np.clip(noisy_or(scores, bags.text, bags.n), 0.0, 1.0) + 0.0
    first = np.searchsorted(bags.text, np.arange(bags.n + 1))
    hit = scores >= least
    some = np.bincount(bags.text, weights=hit, minlength=bags.n) > 0
    for i in np.flatnonzero((whole >= least) & ~some).tolist():
        hit[first[i] + int(np.argmax(scores[first[i]: first[i + 1]]))] = True
    at = np.flatnonzero(hit)
    rows = pa.StructArray.from_arrays([pa.array(bags.start[at], pa.int64()), pa.array((bags.end - bags.start)[at], pa.int64()), pa.array(scores[at])], names=["start", "length", "score"])
    return pa.record_batch({
        "id": part["id"], "n_sentences": pa.array(np.diff(first), pa.int64()), "score": pa.array(whole),
        "sentences": pa.ListArray.from_arrays(pa.array(np.searchsorted(at, first), pa.int32()), rows),
    })

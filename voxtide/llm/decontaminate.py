"""Benchmark items in documents, within an edit distance."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4 << 20   # benchmark text that one pass over the documents takes along
GRAM = 8
SHORT = 32              # shorter items are looked up as they are
BAND = 1.25             # items of a band differ in length by this factor at most
GATE_BITS = 22

# bytes of words: 0-9, a-z and all of a character beyond ASCII; A-Z is lower-cased
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def normal(text: str | None) -> bytes:
    """Lower-case words (letters, digits, anything beyond ASCII) joined by a space."""
    return b" ".join((text or "").encode().translate(_WORD_BYTES).split())


@dataclass(frozen=True)
class Search:
    """edits: how much of an item's length may be edited. recall: the chance that
    a window within that distance shares a key with its item. walks: embeddings
    drawn; sample: symbols of a key. stretch: how many steps of the walk an edit is
    reckoned to change (measured; see tables)."""
    edits: float = 0.05
    recall: float = 0.99
    walks: int = 4
    sample: int = 6
    stretch: float = 9.0
    seed: int = 20240229

    def tables(self, steps: int, edits: int) -> int:
        """Keys for each walk, so that the chance that none agrees is at most 1 - recall."""
        agree = max(0.02, (1 - min(0.95, self.stretch * edits / steps)) ** self.sample)
        return max(1, math.ceil(math.log(1 - self.recall) / math.log(1 - min(agree, 0.999)) / self.walks))


@dataclass
class Band:
    """Items of similar length with the keys of their embeddings."""
    length: int
    edits: int
    least_hits: int
    items: list[int]
    moves: np.ndarray = field(repr=False, default=None)    # walk, step, byte -> 0 or 1
    samples: list[dict[int, list[int]]] = field(repr=False, default=None)  # walk -> step -> tables
    n_tables: int = 0
    keys: np.ndarray = field(repr=False, default=None)     # walk x table, item

    def embed(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Keys (walk x table, window) of the CGK embeddings of the windows.

        The walk reads a byte, writes it, and by a random bit that depends on the
        step and the byte either stays or goes on; two strings that differ by few
        edits fall into step again soon after each. A key is a hash of the bytes
        that were written at the sampled steps."""
        out = np.zeros((len(self.samples) * self.n_tables, len(start)), np.uint64)
        for w, by_step in enumerate(self.samples):
            at = start.copy()
            for step in range(max(by_step) + 1):
                byte = data[at]
                for t in by_step.get(step, ()):
                    row = out[w * self.n_tables + t]
                    row *= np.uint64(0x100000001B3)
                    row += byte
                at += self.moves[w, step][byte].astype(np.int64)
                np.minimum(at, end, out=at)
        return out


class Benchmark:
    """One block of items, ready for the search."""

    def __init__(self, items: tuple[tuple[int, bytes], ...], search: Search):
        self.items, self.search = tuple(items), search
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.limits = [int(search.edits * len(t)) for t in self.texts]
        self.short = [i for i, t in enumerate(self.texts) if 0 < len(t) < SHORT]
        self.gate = np.zeros(1 << GATE_BITS, bool)
        rest = sorted((i for i, t in enumerate(self.texts) if len(t) >= SHORT), key=lambda i: len(self.texts[i]))
        self.bands: list[Band] = []
        rng = np.random.default_rng(search.seed)
        while rest:
            low = len(self.texts[rest[0]])
            own = [i for i in rest if len(self.texts[i]) <= low * BAND]
            rest = rest[len(own):]
            edits = max(self.limits[i] for i in own)
            # an edit spoils GRAM grams at most; what is left must be in the window
            band = Band(low, edits, max(1, low - GRAM + 1 - GRAM * edits), own)
            steps = 2 * low
            band.moves = rng.integers(0, 2, (search.walks, steps, 256), np.uint8)
            band.n_tables = search.tables(steps, edits)
            band.samples = []
            for _ in range(search.walks):
                by_step: dict[int, list[int]] = {}
                for t in range(band.n_tables):
                    for s in rng.choice(steps, search.sample, replace=False):
                        by_step.setdefault(int(s), []).append(t)
                band.samples.append(by_step)
            data = np.frombuffer(b"".join(self.texts[i] + b"\n" for i in own), np.uint8)
            size = np.array([len(self.texts[i]) + 1 for i in own])
            start = np.cumsum(size) - size
            band.keys = band.embed(data, start, start + size - 1)
            self.bands.append(band)
            for i in own:
                self.gate[_gram_hashes(np.frombuffer(self.texts[i], np.uint8))] = True

    def __reduce__(self):
        """Tasks get the items and draw the same walks again, once per worker."""
        return _benchmark, (self.items, self.search)

    def find(self, texts: list[bytes]) -> list[dict[int, tuple[int, int, int]]]:
        """For each text the items it holds: number -> (distance, start, end)."""
        found: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]
        for i in self.short:
            whole = b" " + self.texts[i] + b" "
            for d, text in enumerate(texts):
                at = (b" " + text + b" ").find(whole)
                if at >= 0:
                    found[d][i] = (0, at, at + len(self.texts[i]))
        raw = b"".join(t + b"\n" for t in texts)
        data = np.frombuffer(raw, np.uint8)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        begin = np.cumsum(size) - size
        if not self.bands or len(data) < GRAM:
            return found
        hits = np.append(0, np.cumsum(self.gate[_gram_hashes(data)], dtype=np.int64))
        starts = np.append(0, np.flatnonzero((data[:-1] == 32) | (data[:-1] == 10)) + 1)
        doc = np.searchsorted(begin, starts, side="right") - 1
        end = begin[doc] + size[doc] - 1
        last = len(hits) - 1
        for band in self.bands:
            # windows of the items' size that hold enough of their grams; none within the edit limit is lost
            count = hits[np.minimum(starts + band.length + band.edits, last)] - hits[np.minimum(np.maximum(starts - band.edits, 0), last)]
            ok = np.flatnonzero((count >= band.least_hits) & (end - starts >= band.length - band.edits))
            for at in range(0, len(ok), 50_000):
                part = ok[at: at + 50_000]
                keys = band.embed(data, starts[part], end[part])
                pairs = set()
                for row, items in zip(keys, band.keys):
                    order = np.argsort(items, kind="stable")
                    low = np.searchsorted(items[order], row, side="left")
                    high = np.searchsorted(items[order], row, side="right")
                    for w in np.flatnonzero(high > low):
                        pairs.update((int(w), int(order[k])) for k in range(low[w], high[w]))
                for w, k in sorted(pairs):
                    i, s, d = band.items[k], int(starts[part[w]]), int(doc[part[w]])
                    self._verify(raw, i, s, int(begin[d]), int(end[part[w]]), found[d])
        return found

    def _verify(self, raw: bytes, i: int, start: int, begin: int, end: int, found: dict[int, tuple[int, int, int]]) -> None:
        best, item, limit = found.get(i), self.texts[i], self.limits[i]
        if best is not None and best[0] == 0:
            return
        if raw.startswith(item, start) and start + len(item) <= end:
            found[i] = (0, start - begin, start - begin + len(item))
            return
        low = max(begin, start - limit)
        distance, stop = edit_distance(item, raw[low: min(end, start + len(item) + limit)])
        if distance <= limit and (best is None or distance < best[0]):
            found[i] = (distance, start - begin, low + stop - begin)


@lru_cache(maxsize=2)
def _benchmark(items: tuple[tuple[int, bytes], ...], search: Search) -> Benchmark:
    return Benchmark(items, search)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    words = np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,))
    return ((words * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GATE_BITS)).astype(np.int64)


def edit_distance(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Least number of edits between the pattern and any part of the text, and
    where that part ends. Bit-parallel (Myers 1999), on whole numbers."""
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if score < best[0]:
            best = (score, j + 1)
    return best


def blocks(items: DataFrame, id_col: str, text_col: str, search: Search) -> Iterator[Benchmark]:
    """The benchmark in blocks of bounded size: however long it is, one block at a
    time is sent to the tasks. Null ids and items without a word are left out."""
    rows = items.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = size // BLOCK_BYTES + 1
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).distinct().orderBy("i", "t").collect()
        own = [(r.i, normal(r.t)) for r in part]
        own = [(i, t) for i, t in own if t]
        if own:
            yield Benchmark(own, search)


def _slices(batch: pa.RecordBatch, texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= most):
            size += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
               item_text: str = "text", search: Search = Search()) -> DataFrame:
    """Every (document, item) pair such that some passage of the document is within
    search.edits of the item, counted in edits of its length.

    Both are compared as lower-case words joined by one space. Windows begin at
    words and have the size of the items (by bands of length). A window that cannot
    hold an item, because too few of its byte 8-grams are the benchmark's, is left
    out; that loses none. The CGK walk embeds the other windows and the items, so
    that edit distance becomes Hamming distance, and keys of sampled symbols are
    compared by equality. The keys are as many as search.recall asks for. Every
    pair that shares a key is verified by exact edit distance.

    One pass over the documents for each block of the benchmark; nothing is
    shuffled. Items of fewer than 32 bytes are looked up as they are. Null or empty
    texts hold no item. A repeated item counts by each of its ids. Rows with one id
    or none are documents of their own. Other columns are not read.

    Returns id, item_id, distance, start, length (bytes of the normal form).
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, item_id long, distance long, start long, length long"
    out = None
    for benchmark in blocks(items, item_id, item_text, search):
        def run(batches: Iterator[pa.RecordBatch], benchmark: Benchmark = benchmark) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch["text"].to_pylist()
                for a, b in _slices(batch, texts):
                    found = benchmark.find([normal(x) for x in texts[a:b]])
                    hits = [(a + d, benchmark.ids[i], *f) for d, own in enumerate(found) for i, f in sorted(own.items())]
                    if hits:
                        row, item, distance, start, end = (np.array(x, np.int64) for x in zip(*hits))
                        yield pa.record_batch({"id": batch["id"].take(pa.array(row)), "item_id": pa.array(item), "distance": pa.array(distance),
                                               "start": pa.array(start), "length": pa.array(end - start)})
        own = rows.mapInArrow(run, schema)
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                      search: Search = Search()) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item. Cases as in find_items."""
    columns = docs.columns
    at_text = columns.index(text_col)
    for benchmark in blocks(items, item_id, item_text, search):
        def run(batches: Iterator[pa.RecordBatch], benchmark: Benchmark = benchmark) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(at_text).cast(pa.string()).to_pylist()
                for a, b in _slices(batch, texts):
                    found = benchmark.find([normal(x) for x in texts[a:b]])
                    yield batch.slice(a, b - a).filter(pa.array([not own for own in found]))
        docs = docs.mapInArrow(run, docs.schema)
    return docs

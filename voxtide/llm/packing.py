"""Sequences of fixed length with a steady mixture of sources."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxtide.llm import units as U
from voxtide.llm.quality_rules import _by_bytes
from voxtide.session import cut_lineage

CACHE_WORDS = 1_000_000
MAX_QUEUES = 4096
CELLS = 1 << 20  # windows x queues, or windows of documents, that are looked at together
NEAR = np.arange(-2, 3)  # how far window_of may be off
_CAPITAL, _CLOSING, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = _LETTER[65:91] = _LETTER[97:123] = True
_CLOSING[list(b".,;:!?)")] = True


def pieces_of(texts) -> U.Words:
    """The words of every text, cut and written so that fewer are distinct and each
    still gives the ids it gives in the text: A-Z become a-z, and marks at the end of
    a word stand by themselves where a Latin letter is before them (letters and marks
    are never in one token, and neither joins with what follows). Words with a `<` stay
    as they are, since a special token may be spelled in them."""
    words = U.words_of(texts)
    data, starts, ends = words.data, words.starts, words.ends
    if not len(starts):
        return words
    angles = np.append(0, np.cumsum(data == 60))
    plain = angles[ends] == angles[starts]
    data = np.where(_CAPITAL[data], data | 32, data)
    for a, b in zip(starts[~plain].tolist(), ends[~plain].tolist()):
        data[a:b] = words.data[a:b]
    # the last byte of a word that is no closing mark
    last = np.maximum.accumulate(np.where(_CLOSING[data], -1, np.arange(len(data))))[ends - 1]
    before = data[last - 1]
    latin = _LETTER[data[last]] | ((last > 0) & (before == 0xC3) & (data[last] >= 0x80) & (data[last] != 0x97) & (data[last] != 0xB7))
    cut = plain & (last >= starts) & (last < ends - 1) & latin
    at = np.flatnonzero(cut) + 1
    more = np.append(0, np.cumsum(cut))
    return U.Words(data, words.offsets, np.insert(starts, at, last[cut] + 1), np.insert(ends, at - 1, last[cut] + 1), words.first + more[words.first])


class WordEncoder:
    """Ids of texts by the tokenizers library, for vocabularies that drop white space
    and never join across it: each word is encoded by itself, or each of its `pieces_of`
    if the vocabulary lowers its text, and what it gives is remembered.

    The memory is a few numpy arrays: sorted hashes, and by entry the piece's bytes,
    its ids and when it was last used. A batch is looked up as a whole; the bytes of
    every piece are compared with the entry's, so a hash that two pieces share only
    costs a call. Beyond CACHE_WORDS entries the half not used for longest goes.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.most, self.clock = most, 0
        probes = [["Ab.", "ab", "."], ["É,;", "É", ",;"], ["XyZ", "xyz"]]
        whole = self._call([p[0] for p in probes])
        self.split = pieces_of if all(w == sum(self._call(p[1:]), []) for w, p in zip(whole, probes)) else U.words_of
        self.keys, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted by key
        self.used = np.zeros(0, np.int64)
        self.bytes, self.byte_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.id_at = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def _call(self, pieces: list[str]) -> list[list[int]]:
        return [self.tokenizer.encode(x, add_special_tokens=False).ids for x in pieces]

    def _forget(self) -> None:
        keep = self.used >= np.partition(self.used, len(self.used) // 2)[len(self.used) // 2] if len(self.used) > self.most else np.ones(len(self.used), bool)
        if keep.all():
            if len(self.used) > self.most:  # all of one age
                keep[:] = False
            else:
                return
        number = np.cumsum(keep) - 1
        own = keep[self.entry]
        self.keys, self.entry = self.keys[own], number[self.entry[own]]
        old = np.flatnonzero(keep)
        self.bytes, self.byte_at = _gather(self.bytes, self.byte_at, old)
        self.ids, self.id_at = _gather(self.ids, self.id_at, old)
        self.used = self.used[keep]

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        got = self._call([x.decode() for x in pieces])
        new = np.arange(len(self.used), len(self.used) + len(keys))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.entry = np.insert(self.keys, at, keys), np.insert(self.entry, at, new)
        self.used = np.append(self.used, np.full(len(keys), self.clock))
        self.bytes = np.append(self.bytes, np.frombuffer(b"".join(pieces), np.uint8))
        self.byte_at = np.append(self.byte_at, self.byte_at[-1] + np.cumsum([len(x) for x in pieces]))
        self.ids = np.append(self.ids, np.array([i for x in got for i in x], self.kind))
        self.id_at = np.append(self.id_at, self.id_at[-1] + np.cumsum([len(x) for x in got]))

    def encode(self, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with end_id after it, and their n + 1 offsets."""
        words = self.split(texts)
        self.clock += 1
        self._forget()
        distinct, where, own = np.unique(words.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.append(self.keys, np.uint64(0))[at] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        raw = words.data.tobytes()
        fresh = np.flatnonzero(~known | (at >= len(self.keys)))
        if len(fresh):
            self._learn(distinct[fresh], [raw[words.starts[i]: words.ends[i]] for i in where[fresh].tolist()])
            at = np.searchsorted(self.keys, distinct)
        entry = self.entry[at]
        self.used[entry] = self.clock
        entry = entry[own]
        odd = np.flatnonzero(~_same(words, self.bytes, self.byte_at, entry))
        ids, id_at = self.ids, self.id_at
        extra = [raw[words.starts[i]: words.ends[i]] for i in odd.tolist()]
        # two more entries for this call: the end, and pieces whose hash belongs to another
        tail = [[end_id], *self._call([x.decode() for x in extra])]
        entry[odd] = len(self.used) + 1 + np.arange(len(odd))
        ids = np.append(ids, np.array([i for x in tail for i in x], self.kind))
        id_at = np.append(id_at, id_at[-1] + np.cumsum([len(x) for x in tail]))
        entry = np.insert(entry, words.first[1:], len(self.used))
        out, bounds = _gather(ids, id_at, entry)
        return out, bounds[words.first + np.arange(len(words.first))]


def _gather(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The given rows of a ragged array, one after the other, and their offsets."""
    size = at[rows + 1] - at[rows]
    bounds = np.append(0, np.cumsum(size))
    return values[np.repeat(at[rows] - bounds[:-1], size) + np.arange(bounds[-1])], bounds


def _same(words: U.Words, values: np.ndarray, at: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Whether each word has the bytes of its entry."""
    size = words.ends - words.starts
    ok = at[entry + 1] - at[entry] == size
    size = np.where(ok, size, 0)
    bounds = np.append(0, np.cumsum(size))
    step = np.arange(bounds[-1])
    unlike = words.data[np.repeat(words.starts - bounds[:-1], size) + step] != values[np.repeat(at[entry] - bounds[:-1], size) + step]
    sums = np.append(0, np.cumsum(unlike))
    return ok & (sums[bounds[1:]] == sums[bounds[:-1]])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    return WordEncoder(path)


class Mixture:
    """Deficit round-robin in closed form.

    Every queue earns its share of each window and is served in turn by whole
    tokens; what it has earned but not got (its deficit, below one token) it
    carries into the next window. So token q of queue s is due when the queue has
    earned q + 1/2 tokens, at time (q + 1/2) / share, and the tokens of all queues
    in the order of their times fill the windows. When a queue runs dry the others
    share what it leaves. Any window can be computed by itself, in any task: the
    deficits carried into it follow from its number.
    """

    def __init__(self, tokens: np.ndarray, shares: np.ndarray, length: int):
        self.tokens, self.shares, self.length = tokens.astype(np.int64), shares.astype(np.float64), length
        self.total = int(self.tokens.sum())
        dry = np.unique(np.append(0.0, self.tokens / self.shares))
        self.times = dry
        self.fluid = np.minimum(self.tokens, np.outer(dry, self.shares)).sum(axis=1)

    def served(self, window: np.ndarray) -> np.ndarray:
        """Tokens of each queue in all windows before the given ones."""
        goal = np.minimum(window * self.length, self.total)
        time = np.interp(goal, self.fluid, self.times)
        out = np.minimum(self.tokens, np.floor(time[:, None] * self.shares + 0.5).astype(np.int64))
        lack = goal - out.sum(axis=1)
        while True:
            row = np.flatnonzero(lack > 0)
            if not len(row):
                break
            due = np.where(out[row] < self.tokens, (out[row] + 0.5) / self.shares, np.inf)
            out[row, np.argmin(due, axis=1)] += 1
            lack[row] -= 1
        while True:
            row = np.flatnonzero(lack < 0)
            if not len(row):
                return out
            due = np.where(out[row] > 0, (out[row] - 0.5) / self.shares, -np.inf)
            out[row, out.shape[1] - 1 - np.argmax(due[:, ::-1], axis=1)] -= 1
            lack[row] += 1

    def window_of(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The window of the token at a place of a queue; may be off by a few."""
        time = (place + 0.5) / self.shares[queue]
        return (np.interp(time, self.times, self.fluid) // self.length).astype(np.int64)

    def pieces(self, queue: np.ndarray, start: np.ndarray, size: np.ndarray):
        """Cut runs of places [start, start + size) of queues at the windows. Yields
        run number, window, first place, length, offset in the window, for some of
        the pieces at a time.

        A run has pieces in no more windows than it has tokens. Where its windows are
        many more, as its queue has few tokens a window, only those near the tokens'
        own are looked at."""
        low = np.maximum(self.window_of(queue, start) + NEAR[0], 0)
        high = self.window_of(queue, start + size - 1) + NEAR[-1]
        count = np.minimum(high - low + 1, len(NEAR) * size)
        sparse = high - low + 1 > count
        part = (np.cumsum(count) - count) // CELLS
        for own in np.split(np.arange(len(start)), np.flatnonzero(np.diff(part)) + 1):
            full = own[~sparse[own]]
            n = count[full]
            runs = [np.repeat(full, n)]
            windows = [np.repeat(low[full] - np.cumsum(n) + n, n) + np.arange(len(runs[0]))]
            for r in own[sparse[own]].tolist():
                place = np.arange(start[r], start[r] + size[r])
                near = np.unique(np.maximum(self.window_of(np.full(len(place), queue[r]), place)[:, None] + NEAR, 0))
                runs.append(np.full(len(near), r))
                windows.append(near)
            run, window = np.concatenate(runs), np.concatenate(windows)
            order = np.lexsort((run, window))
            run, window = run[order], window[order]
            new = np.cumsum(np.diff(window, prepend=window[:1]) != 0)
            chunk = new // max(1, CELLS // len(self.tokens))
            for at in np.split(np.arange(len(run)), np.flatnonzero(np.diff(chunk)) + 1):
                yield self._cut(run[at], window[at], queue, start, size)

    def _cut(self, run: np.ndarray, window: np.ndarray, queue: np.ndarray, start: np.ndarray, size: np.ndarray):
        need, at = np.unique(window, return_inverse=True)
        before, after = self.served(need), self.served(need + 1)
        q = queue[run]
        a = np.maximum(before[at, q], start[run])
        b = np.minimum(after[at, q], start[run] + size[run])
        ahead = np.cumsum(after - before, axis=1) - (after - before)
        offset = ahead[at, q] + a - before[at, q]
        ok = b > a
        return run[ok], window[ok], a[ok], (b - a)[ok], offset[ok]


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, source, ids (packed), n, seg (the task that wrote the row), local (ids
    of the same source before it in that task). Written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, seen = TaskContext.get().partitionId(), {}
        encode = encoder(path)
        for batch in batches:
            for part in _by_bytes(batch, 1 << 19):
                ids, at = encode.encode(part["text"], end_id)
                n = np.diff(at)
                local = []
                for source, k in zip(part["source"].to_pylist(), n.tolist()):
                    local.append(seen.get(source, 0))
                    seen[source] = local[-1] + k
                yield pa.record_batch({
                    "id": part["id"], "source": part["source"], "ids": U.binaries(ids.view(np.uint8), at * encode.kind.itemsize).cast(pa.binary()), "n": pa.array(n, pa.int64()),
                    "seg": pa.array([seg] * len(n), pa.int64()), "local": pa.array(local, pa.int64()),
                })

    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    return cut_lineage(rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, source string, ids binary, n long, seg long, local long"))


def pack(docs: DataFrame, path: str, end_id: int = 2, length: int = 4096, shares: dict[str | None, float] | None = None,
         id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_ids: bool = True) -> DataFrame:
    """Cut all documents into sequences of `length` tokens, each with the target
    proportions of sources.

    A document is its ids by the tokenizers library plus end_id; its source's queue
    holds documents in the order they were tokenized. `shares` are the target
    proportions by source (default, and for sources not named: what the source has
    of all tokens, scaled to stand beside the named ones). Mixture says who fills
    which window. Every sequence but the last is full; none needs padding inside.

    Texts are tokenized once, into a table in the shared folder. Queue starts are
    prefix sums over (source, task); that small table meets the ids by a join that
    Spark broadcasts only if the written file is below its threshold. The driver
    holds one number per source; beyond MAX_QUEUES sources those that `shares`
    does not name share queues by hash (each queue keeps the proportion of its
    sources together).

    A null or empty text is end_id alone. A null source is a source of its own.
    Rows with one id, or a null id, are documents of their own. Extra columns are
    not read. An empty table gives no piece.

    Returns per piece id, start (in its document), length, ids (little-endian
    32-bit, null unless with_ids), ids_crc32, doc_tokens, sequence_id, offset, source.
    """
    spark = docs.sparkSession
    rows = tokenize(docs, path, end_id, id_col, text_col, source_col)
    sums = cut_lineage(rows.groupBy("source", "seg").agg(F.sum("n").alias("n")))
    n_sources = sums.select("source").distinct().count()
    queue = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    if n_sources > MAX_QUEUES:
        named = [x for x in shares or {} if x is not None]
        own = F.coalesce(F.col("source").isin(named), F.lit(None in (shares or {})))
        queue = F.when(own, queue).otherwise(F.pmod(F.xxhash64("source"), F.lit(MAX_QUEUES)).cast("string"))
    by_task = W.partitionBy("queue").orderBy("seg", "source").rowsBetween(W.unboundedPreceding, -1)
    starts = cut_lineage(sums.withColumn("queue", queue).withColumn("before", F.coalesce(F.sum("n").over(by_task), F.lit(0))))
    totals = starts.groupBy("queue").agg(F.sum("n").alias("n"), F.min("source").alias("source")).orderBy("queue").collect()
    names = {r.queue: i for i, r in enumerate(totals)}
    tokens = np.array([r.n for r in totals], np.float64)
    weight = tokens / max(tokens.sum(), 1)
    for i, r in enumerate(totals):
        if shares and r.source in shares:
            weight[i] = shares[r.source]
    if not totals:
        weight, tokens = np.ones(1), np.zeros(1)
    mixture = Mixture(tokens, weight, length)
    kind = encoder(path).kind.str
    joined = rows.select("id", "source", "ids", "n", "seg", "local").join(
        starts.select(F.col("source").alias("s"), F.col("seg").alias("g"), "queue", "before"), F.col("source").eqNullSafe(F.col("s")) & (F.col("seg") == F.col("g")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                which = np.array([names[x] for x in batch["queue"].to_pylist()])
                size = batch["n"].to_numpy(zero_copy_only=False)
                begin = batch["before"].to_numpy(zero_copy_only=False) + batch["local"].to_numpy(zero_copy_only=False)
                docs_ids = [np.frombuffer(x.as_buffer(), kind).astype("<u4") for x in batch["ids"]]
                for run, window, place, count, offset in mixture.pieces(which, begin, size):
                    start = place - begin[run]
                    bodies = [docs_ids[r][s: s + c].tobytes() for r, s, c in zip(run.tolist(), start.tolist(), count.tolist())]
                    yield pa.record_batch({
                        "id": batch["id"].take(pa.array(run)), "start": pa.array(start, pa.int64()), "length": pa.array(count, pa.int64()),
                        "ids": pa.array(bodies if with_ids else [None] * len(bodies), pa.binary()), "ids_crc32": pa.array([zlib.crc32(x) for x in bodies], pa.int64()),
                        "doc_tokens": pa.array(size[run], pa.int64()), "sequence_id": pa.array(window, pa.int64()), "offset": pa.array(offset, pa.int64()),
                        "source": batch["source"].take(pa.array(run)),
                    })

    out = joined.select("id", "source", "ids", "n", "local", "queue", "before").mapInArrow(
        cut, f"id {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
    return out.withColumnRenamed("id", id_col)

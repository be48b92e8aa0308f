"""Repeated runs of lines, found through winnowed fingerprints."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm import units as U

NO_ID = np.iinfo(np.int64).max


def _lines(text: bytes) -> tuple[list[bytes], list[int], list[int], list[int]]:
    """All lines of a text; the numbers, hashes and word counts of those that have
    a word. White space does not count: words are joined by one space."""
    lines = text.split(b"\n")
    where, hashes, sizes = [], [], []
    for i, line in enumerate(lines):
        words = line.split()
        if words:
            where.append(i)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(words)))
            sizes.append(len(words))
    return lines, where, hashes, sizes


def winnow(hashes: list[int], run: int) -> list[tuple[int, int, int]]:
    """(fingerprint position, first window, last window) for windows of `run`
    hashes: each window selects the first of its least hashes, and windows that
    select one position share a fingerprint. Any run of that many lines that
    stands twice is sure to have a fingerprint in common."""
    out: list[tuple[int, int, int]] = []
    for start in range(len(hashes) - run + 1):
        window = hashes[start: start + run]
        at = start + window.index(min(window))
        if out and out[-1][0] == at:
            out[-1] = (at, out[-1][1], start)
        else:
            out.append((at, start, start))
    return out


def wordy(hashes: list[int], sizes: list[int], run: int, words: int) -> list[tuple[int, int, int]]:
    """(hash, start, number of lines) of the windows of less than `run` lines that
    hold `words` words and more."""
    total = np.append(0, np.cumsum(sizes, dtype=np.int64))
    return [(xxhash.xxh64_intdigest(np.array(hashes[i: i + n], np.uint64).tobytes(), n), i, n)
            for n in range(1, run) for i in np.flatnonzero(total[n:] - total[:-n] >= words).tolist()]


class _Unit:
    def __init__(self, table: pa.Table, run: int, words: int | None):
        """Fingerprints of a unit with the lines around them, as far as a window
        reaches both ways. Equal surroundings are kept once, at their first place.
        A wordy window of fewer lines stands for itself: it is its own fingerprint,
        and `run` times its hash are its only surroundings."""
        self.texts = [x.encode() for x in U.flat(table["text"]).to_pylist()]
        ids = [NO_ID if x is None else x for x in U.flat(table["id"]).to_pylist()]
        self.lines, self.where, self.places, self.marks, self.orders = [], [], {}, [], []
        for d, text in enumerate(self.texts):
            lines, where, hashes, sizes = _lines(text)
            self.lines.append(lines)
            self.where.append(where)
            tie = None
            found = [((hashes[at], *hashes[first: last + run]), first, last, run) for at, first, last in winnow(hashes, run)]
            if words is not None:
                found += [((h,) * (run + 1), i, i, n) for h, i, n in wordy(hashes, sizes, run, words)]
            for around, first, last, n in found:
                place = self.places.setdefault(around, len(self.places))
                if place == len(self.orders):
                    tie = xxhash.xxh64_intdigest(text) >> 1 if tie is None else tie
                    self.orders.append((ids[d], tie, first))
                    self.marks.append((d, first, last, n, place, False))
                else:
                    self.marks.append((d, first, last, n, place, True))
        self.around = list(self.places)

    def buckets(self, n: int) -> np.ndarray:
        """Bucket of each fingerprint; least hashes are small ones, so they are mixed again."""
        return U.bucket_of(U.mix(np.array([a[0] for a in self.around], np.uint64) + np.uint64(1)), n)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_run: int = 3,
               carry: tuple[str, ...] = (), min_words: int | None = None) -> DataFrame:
    """Delete every line that lies in a run of min_run consecutive lines which
    also stands earlier, in a document with a smaller id or further up in the same.
    With min_words, runs of fewer lines count too if they have that many words; one
    long line is enough.

    Winnowing: of every window of min_run line hashes the least is a fingerprint.
    Fingerprints of all documents are joined by value; each comes with the lines
    around it, and a match is extended both ways as far as a window reaches.
    Windows that match an earlier place delete their lines; neighbouring windows
    add up to the whole run. The first occurrence of a run always stays. Runs are
    judged on the input. Surroundings that a unit holds often are sent once.

    Lines end at \\n. A line is compared by its words, whatever white space stands
    between; lines without a word are not counted and stay. Runs do not cross
    documents. Ids are whole numbers, a null id comes after all others; rows that
    share an id are ordered by a hash of their text, and of rows that are equal
    altogether the first one stays. A null text is empty and comes back empty.

    Returns id, n_lines (with a word), n_removed, spans (start, length: line
    numbers from 0), kept_text, then the columns in `carry`, named by position
    c0, c1, ... Each row gives one row.
    """
    dealt = U.deal(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, carry=carry)
    buckets = dealt.buckets

    def send(key, table):
        me, unit = key[0].as_py(), _Unit(U.in_order(table), min_run, min_words)
        if not unit.around:
            return U.mail(me, np.zeros(0, np.int64), pa.array([], pa.large_binary()))
        bucket = unit.buckets(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(bucket)]
        blobs = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = [unit.around[i] for i in order[a:b]]
            blobs.append(b"".join([
                np.uint32(b - a).tobytes(), np.array([unit.orders[i] for i in order[a:b]], np.int64).tobytes(),
                np.array([len(x) - 1 for x in part], np.int32).tobytes(), np.array([h for x in part for h in x[1:]], np.uint64).tobytes(),
            ]))
        return U.mail(me, bucket[cuts[:-1]], pa.array(blobs, pa.large_binary()))

    def match(key, table):
        """Extend the matches of a bucket and find the earliest place of each."""
        blobs = [x.as_py() for x in U.flat(table["blob"])]
        orders, sizes, hashes = [], [], []
        for blob in blobs:
            n = int(np.frombuffer(blob, np.uint32, 1)[0])
            orders.append(np.frombuffer(blob, np.int64, 3 * n, 4).reshape(n, 3))
            sizes.append(np.frombuffer(blob, np.int32, n, 4 + 24 * n).astype(np.int64))
            hashes.append(np.frombuffer(blob, np.uint64, -1, 4 + 28 * n))
        order, size, line = map(np.concatenate, (orders, sizes, hashes))
        count = size - min_run + 1
        entry = np.repeat(np.arange(len(size)), count)
        inner = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
        start = inner + np.repeat(np.cumsum(size) - size, count)
        h1, h2 = U.window_hashes(line, min_run)[start], U.window_hashes(line, min_run, True)[start]
        by = np.lexsort((order[entry, 2] + inner, order[entry, 1], order[entry, 0], h2, h1))
        hit = np.zeros(len(by), bool)
        hit[by[1:]] = (h1[by[1:]] == h1[by[:-1]]) & (h2[by[1:]] == h2[by[:-1]])
        ends = np.cumsum([int((s - min_run + 1).sum()) for s in sizes])
        starts = np.append(0, ends[:-1])
        back = [np.uint32(b - a).tobytes() + np.packbits(hit[a:b]).tobytes() for a, b in zip(starts, ends)]
        return pa.table({"_unit": table["_unit"], "bucket": table["bucket"], "blob": pa.array(back, pa.binary())})

    def cut(key, table, replies):
        table = U.in_order(table)
        unit = _Unit(table, min_run, min_words)
        flags, _ = U.answers(replies)
        at = np.zeros(len(unit.around), np.int64)
        if unit.around:
            bucket = unit.buckets(buckets)
            order = np.argsort(bucket, kind="stable")
            counts = np.array([len(a) - min_run for a in unit.around], np.int64)
            at[order] = np.cumsum(counts[order]) - counts[order]
        gone: list[set[int]] = [set() for _ in unit.texts]
        for d, first, last, n, place, later in unit.marks:
            for w in range(first, last + 1):
                if later or flags[at[place] + w - first]:
                    gone[d].update(unit.where[d][w: w + n])
        kept, spans = [], []
        for lines, out in zip(unit.lines, gone):
            kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in out).decode())
            runs: list[dict] = []
            for i in sorted(out):
                if runs and runs[-1]["start"] + runs[-1]["length"] == i:
                    runs[-1]["length"] += 1
                else:
                    runs.append({"start": i, "length": 1})
            spans.append(runs)
        return pa.table({
            "id": table["id"], "n_lines": pa.array([len(x) for x in unit.where], pa.int64()), "n_removed": pa.array([len(x) for x in gone], pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), "kept_text": pa.array(kept, pa.string()),
            **{f"c{i}": table[f"c{i}"] for i in range(len(carry))},
        })

    mail = dealt.rows.groupBy("_unit").applyInArrow(send, U.MAIL).groupBy("bucket").applyInArrow(match, U.MAIL)
    schema = f"id long, n_lines long, n_removed long, spans {U.SPANS}, kept_text string"
    for i, c in enumerate(carry):
        schema += f", c{i} {docs.schema[c].dataType.simpleString()}"
    return dealt.rows.groupBy("_unit").cogroup(mail.groupBy("_unit")).applyInArrow(cut, schema).withColumnRenamed("id", id_col)

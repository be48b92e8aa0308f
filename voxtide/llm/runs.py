"""Periodic runs of words, as maximal pairs of each text's common-prefix interval tree."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm import units as U
from voxtide.llm.quality_rules import _by_bytes
from voxtide.llm.substring_dedup import _kept

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def suffix_order(words: np.ndarray, text: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the one before, a number for the
    word at every place): those that share `least` words or more with a neighbour,
    every text by itself.

    words: word hashes; text: the text of each word; end: where that text ends. Prefix
    doubling: after k rounds the rank of a place says which 2^k words stand there, cut
    at the end of the text, and only places whose rank is not theirs alone are sorted
    on. The ranks of all rounds give the common prefixes.
    """
    n = len(words)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, np.int32)
    key = U.mix(words ^ U.mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.append(True, sorted_key[1:] != sorted_key[:-1])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rounds, step = [rank], 1
    # `order` holds the places by rank; `head` marks where a rank begins
    while True:
        alone = head & np.append(head[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        place = order[at]
        ahead = place + step
        inside = ahead < end[place]
        # a text that ends comes first; its length tells it apart from all others
        second = np.where(inside, rank[np.minimum(ahead, n - 1)].astype(np.int64) + n, end[place] - place)
        first = rank[place]
        by = np.lexsort((second, first))
        place, first, second = place[by], first[by], second[by]
        order[at] = place
        new = np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        head[at] = new
        rank = rank.copy()
        rank[place] = np.maximum.accumulate(np.where(new, at, 0))
        rounds.append(rank)
        step *= 2
    a, b = order[:-1], order[1:]
    known = rounds[min(least.bit_length() - 1, len(rounds) - 1)]
    both = np.flatnonzero(known[a] == known[b])
    i, j, shared = a[both].copy(), b[both].copy(), np.zeros(len(both), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        ok = (i < end[a[both]]) & (j < end[b[both]])
        ok[ok] = rounds[k][i[ok]] == rounds[k][j[ok]]
        # equal ranks mean equal words up to 2^k, unless a text ends: then the ranks differ
        i[ok] += 1 << k
        j[ok] += 1 << k
        shared[ok] += 1 << k
    prefix = np.zeros(n, np.int64)
    prefix[both + 1] = shared
    keep = (prefix >= least) | np.append(prefix[1:] >= least, False)
    prefix[prefix < least] = 0
    return order[keep], prefix[keep], rounds[0]


class Places:
    """The places of an interval: all, and by the word on their left."""

    __slots__ = ("all", "by_left")

    def __init__(self, place: int, left: int):
        self.all, self.by_left = [place], {left: [place]}


def join(a: Places, b: Places, depth: int, lefts: dict[int, int], times: int, found: dict[tuple[int, int], int]) -> Places:
    """Report the maximal pairs between two children of an interval of common prefix
    `depth` that lie at most depth / (times - 1) apart, and merge the children.

    A pair (p, p + d) from different children cannot be extended to the right, and one
    with different words on the left not to the left: the words p .. p + d + depth are
    a stretch of period d that ends there, at least `times` periods long if
    d * (times - 1) <= depth. The smaller child's places look into the larger one; there
    only classes of another left word are walked.
    """
    if len(a.all) < len(b.all):
        a, b = b, a
    far = depth // (times - 1)
    for p in b.all:
        lo = bisect_left(a.all, p - far)
        hi = bisect_right(a.all, p + far, lo)
        if lo == hi:
            continue
        left = lefts[p]
        if hi - lo <= len(a.by_left):
            near = [q for q in a.all[lo:hi] if lefts[q] != left]
        else:
            near = []
            for other, places in a.by_left.items():
                if other != left:
                    near += places[bisect_left(places, p - far): bisect_right(places, p + far)]
        for q in near:
            s, d = (p, q - p) if p < q else (q, p - q)
            if d < found.get((s, depth + d), depth + 1):
                found[s, depth + d] = d
    # every place is merged into a set at least twice the size: log n times at most
    if len(b.all) == 1:
        insort(a.all, b.all[0])
    else:
        a.all = sorted(a.all + b.all)
    for left, places in b.by_left.items():
        own = a.by_left.get(left)
        if own is None:
            a.by_left[left] = places
        elif len(places) == 1:
            insort(own, places[0])
        else:
            a.by_left[left] = sorted(own + places)
    return a


def maximal_pairs(order: list[int], prefix: list[int], lefts: dict[int, int], times: int) -> dict[tuple[int, int], int]:
    """(start, length) of every stretch given by a maximal pair, with its least period.

    One scan with a stack over suffixes in order and their common prefixes walks the
    interval tree from the leaves up. A prefix of 0 ends a tree."""
    found: dict[tuple[int, int], int] = {}
    depths: list[int] = []
    sets: list[Places] = []
    now = None
    for place, depth in zip([*order, -1], [*prefix, 0]):
        while depths and depths[-1] > depth:
            now = join(sets.pop(), now, depths.pop(), lefts, times, found)
        if depths and depths[-1] == depth:
            sets[-1] = join(sets[-1], now, depth, lefts, times, found)
        elif depth:
            depths.append(depth)
            sets.append(now)
        if place >= 0:
            now = Places(place, lefts[place])
    return found


def runs_of(words: np.ndarray, first: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of all texts, by start, then period: maximal
    stretches of least period q and length >= max(least, times * q). Starts count words
    of all texts; text i has the words first[i] .. first[i + 1]."""
    n = len(words)
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    # a run repeats its first `shared` words or more at a distance of its period
    shared = max(1, min(max(least, times * q) - q for q in range(1, least + 1)))
    order, prefix, names = suffix_order(words, text, np.repeat(first[1:], size), shared)
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    left = np.append(-1, names[:-1])
    left[first[:-1][size > 0]] = -1  # nothing stands before a text
    lefts = dict(zip(order.tolist(), left[order].tolist()))
    found = maximal_pairs(order.tolist(), prefix.tolist(), lefts, times)
    rows = np.array([(s, m, q) for (s, m), q in found.items() if m >= least], np.int64).reshape(-1, 3)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """The periodic runs of every text's words [^\\x20\\x09-\\x0D]+.

    A run is a stretch of words of least period q, at least `times` * q and `least`
    words long, that no neighbouring word extends with that period. An enhanced suffix
    array of each text (prefix doubling in numpy over slices of whole texts) gives the
    common-prefix intervals of the places that can be in a run; a stack scan walks them
    from the leaves up, with the places of an interval kept by the word on their left,
    and reports the maximal pairs at most a third of their common prefix apart (for
    `times` = 4). These are exactly the runs: nothing is extended. Of pairs that give
    one stretch the least distance is its period. Words are told apart by 64-bit hashes.

    One pass, no shuffle. Memory is that of a slice of about 1 MB, or of one text.

    A null or empty text has no words and no runs. Each row gives one row; ids may
    repeat or be null; columns of other names are not read.

    Returns id, n_words, runs (start, length, period by start, then period), best (the
    run with most periods; ties go to the smallest start, then period), kept (the words
    outside every run's part after its first period, joined by one space).
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_bytes(batch):
                yield _runs(part, least, times)

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<{RUN}>, best {RUN}, kept string").withColumnRenamed("id", id_col)


def _outside(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words lie in no run's part after its first period."""
    depth = np.bincount(start + period, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(depth)[:n] == 0


def _runs(part: pa.RecordBatch, least: int, times: int) -> pa.RecordBatch:
    words = U.words_of(part["text"])
    first = words.first
    start, length, period = runs_of(words.hashes(), first, least, times)
    at = np.searchsorted(start, first)
    text = np.searchsorted(first, start, side="right") - 1
    # most periods first, compared as whole numbers: length * other period
    best: list[int] = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        top = -1
        for i in range(a, b):
            if top < 0 or int(length[i]) * int(period[top]) > int(length[top]) * int(period[i]):
                top = i
        best.append(top)
    rows = pa.StructArray.from_arrays([pa.array(start - first[text], pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], names=["start", "length", "period"])
    data, offsets = _kept(words, _outside(int(first[-1]), start, length, period))
    return pa.record_batch({
        "id": part["id"], "n_words": pa.array(np.diff(first), pa.int64()), "runs": pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows),
        "best": rows.take(pa.array([None if i < 0 else i for i in best], pa.int64())), "kept": U.strings(data, offsets),
    })

"""Repeated word windows, found level by level."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxtide.llm import units as U


def levels(min_words: int, start_words: int) -> list[int]:
    """Window lengths that double (the last step at most) up to min_words."""
    out = [min_words]
    while out[0] > max(1, start_words):
        out.insert(0, (out[0] + 1) // 2)
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 35,
                    start_words: int = 20) -> DataFrame:
    """Remove every word covered by a window of min_words words whose sequence
    also starts elsewhere, in the same document or another.

    Level-wise doubling: at the first length all windows are compared. A window
    of the next length, up to twice as long, is a candidate only if the windows
    of the last length at its beginning and at its end were both found repeated;
    all others are done with. Levels stop at min_words (a longer window covers no
    further word); where no candidate survives, the later levels have nothing to
    compare. Hashes of the short levels are cut to a bucket and 31 bits and only
    thin out; the last level compares 128 bits.

    Words are [^\\x20\\x09-\\x0D]+, unchanged. All copies of a window go, the first
    included. A null or empty text has no words and comes back empty. Rows are
    taken as they are: repeated rows and repeated or null ids are separate
    documents and each gives one row. Other columns are not read.

    Returns id, n_words, n_removed, spans (start, length in words), kept_text
    (kept words joined by one space).
    """
    dealt = U.deal(docs, id_col, text_col)
    lengths = levels(min_words, start_words)
    buckets = dealt.buckets

    def emit(unit: int, words: U.Words, hashes: np.ndarray, at: np.ndarray, length: int) -> pa.Table:
        h1, h2 = _keys(hashes, at, length, length == min_words)
        where, _, counts = U.distinct(h1, h2, buckets)
        return U.ask(unit, buckets, h1[where], None if h2 is None else h2[where], counts > 1)

    def first(key, table):
        words = U.words_of(table["text"])
        return emit(key[0].as_py(), words, words.hashes(), np.flatnonzero(words.inside(lengths[0])), lengths[0])

    def survivors(table, replies, k):
        """Words and hashes of a unit, and where windows of level k repeat."""
        words = U.words_of(table["text"])
        hashes = words.hashes()
        flags, notes = U.answers(replies)
        at = np.flatnonzero(words.inside(lengths[0])) if k == 0 else (np.frombuffer(notes[0], np.int64) if notes else np.zeros(0, np.int64))
        if len(at):
            h1, h2 = _keys(hashes, at, lengths[k], lengths[k] == min_words)
            _, number, _ = U.distinct(h1, h2, buckets)
            at = at[flags[number]]
        return words, hashes, at

    def step(k):
        def run(key, table, replies):
            unit = key[0].as_py()
            words, hashes, at = survivors(U.in_order(table), replies, k)
            if not len(at):
                return U.mail(unit, np.zeros(0, np.int64), pa.array([], pa.large_binary()))
            length = lengths[k + 1]
            found = np.zeros(len(words.starts) + length, bool)
            found[at] = True
            inside = words.inside(length)
            here = at[at < len(inside)]
            here = here[inside[here] & found[here + length - lengths[k]]]
            return pa.concat_tables([U.note(unit, here.astype(np.int64).tobytes()), emit(unit, words, hashes, here, length)])
        return run

    def last(key, table, replies):
        table = U.in_order(table)
        words, _, at = survivors(table, replies, len(lengths) - 1)
        n, docs_n = len(words.starts), table.num_rows
        gone = U.covered(n, at, min_words)
        starts, ends = U.runs(gone, words.first)
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) if docs_n else np.zeros(0, np.int64)
        removed[np.diff(words.first) == 0] = 0
        data, offsets = _kept(words, ~gone)
        return pa.table({
            "id": table["id"], "n_words": pa.array(np.diff(words.first), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "spans": U.span_lists(starts, ends, words.first), "kept_text": U.strings(data, offsets),
        })

    rows = dealt.rows
    mail = rows.groupBy("_unit").applyInArrow(first, U.MAIL)
    for k in range(len(lengths)):
        width = 16 if lengths[k] == min_words else 4
        replies = mail.groupBy("bucket").applyInArrow(U.answer(width), U.MAIL).groupBy("_unit")
        pair = rows.groupBy("_unit").cogroup(replies)
        if k + 1 < len(lengths):
            mail = pair.applyInArrow(step(k), U.MAIL)
    out = pair.applyInArrow(last, f"id {dealt.id_type}, n_words long, n_removed long, spans {U.SPANS}, kept_text string")
    return out.withColumnRenamed("id", id_col)


def _keys(hashes: np.ndarray, at: np.ndarray, length: int, exact: bool):
    return U.window_hashes(hashes, length)[at], (U.window_hashes(hashes, length, True)[at] if exact else None)


def _kept(words: U.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each text joined by one space."""
    data = words.data.copy()
    data[words.ends] = 32  # the byte after a word is white space; it becomes the joint
    starts, ends = words.starts[keep], words.ends[keep]
    text = np.searchsorted(words.first, np.flatnonzero(keep), side="right") - 1
    final = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    ends = ends + 1 - final  # no joint after a text's last word
    depth = np.zeros(len(data) + 1, np.int8)
    depth[starts] += 1
    depth[ends] -= 1
    mask = np.cumsum(depth[:-1], dtype=np.int8).astype(bool)
    sizes = np.bincount(text, weights=ends - starts, minlength=len(words.first) - 1) if len(text) else np.zeros(len(words.first) - 1)
    return data[mask], np.append(0, np.cumsum(sizes.astype(np.int64)))

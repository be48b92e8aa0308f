"""Repeated byte strings, found on enhanced suffix arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm import units as U

GRAM = 16
UNIT_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).max
START = 256    # left neighbour of a string that begins its document
MIXED = 257    # left neighbours differ


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int, bool]]:
    """The common-prefix interval tree above `least`, by one scan with a stack.

    lcp[i] is the common prefix of sorted suffixes i - 1 and i (lcp[0] is not
    read). Yields (first, last, prefix length, whether it is a root: no larger
    interval reaches `least`).
    """
    out, stack = [], []
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            out.append((first, i - 1, length, now < least and not stack))
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))
    return out


class _Unit:
    """Bytes of a unit, and its windows in runs that share the gram that is least in
    each: first byte (at), number of windows (count), document and hash of the gram.
    Documents are taken a few at a time, so that what is computed for every byte
    stays small."""

    SLICE = 1 << 17

    def __init__(self, table: pa.Table, least: int):
        self.data, self.offsets = U.text_bytes(table["text"])
        self.ids = U.flat(table["id"].cast(pa.int64())).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        parts, low = [], 0
        while low < len(self.ids):
            high = max(low + 1, int(np.searchsorted(self.offsets, self.offsets[low] + self.SLICE, side="right")) - 1)
            parts.append(self._runs(low, high, least))
            low = high
        self.at, self.count, self.doc = (np.concatenate([np.zeros(0, np.int64), *[x[i] for x in parts]]) for i in range(3))
        self.hash = np.concatenate([np.zeros(0, np.uint64), *[x[3] for x in parts]])

    def _runs(self, low: int, high: int, least: int):
        base = self.offsets[low]
        data, offsets = self.data[base: self.offsets[high]], self.offsets[low: high + 1] - base
        count = np.maximum(np.diff(offsets) - least + 1, 0)
        if not count.sum():
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        gram = min(GRAM, least)
        hashes = _grams(data, gram)
        key = (hashes & ~np.uint64(0xFFFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        key = _sliding_min(key, least - gram + 1) & np.uint64(0xFFFFFFFF)
        doc = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(offsets[:-1], count)
        key = key[at].astype(np.int64)
        first = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
        # least hashes are small ones: mixed again, they spread over the buckets
        return at[first] + base, np.diff(np.append(first, len(at))), doc[first] + low, U.mix(hashes[key[first]] + np.uint64(1))


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all strings of `gram` bytes."""
    n = len(data) - gram + 1
    padded = np.append(data, np.zeros(8, np.uint8))
    word = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = np.zeros(n, np.uint64)
    for at in range(0, gram, 8):
        part = word[at: at + n].copy()
        if gram - at < 8:
            part &= np.uint64((1 << 8 * (gram - at)) - 1)
        out = (out ^ part) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return U.mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i + width], by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def suffix_mail(docs: DataFrame, id_col: str, text_col: str, least: int, groups: bool):
    """Rows by unit, and what the buckets answer them."""
    dealt = U.deal(docs.withColumn(id_col, F.col(id_col).cast("long")), id_col, text_col, UNIT_BYTES)
    buckets = dealt.buckets

    def anchors(key, table):
        """Which least grams does another document have?"""
        unit = _Unit(U.in_order(table), least)
        h, doc = unit.hash, unit.doc
        where, number, _ = U.distinct(h, None, buckets)
        low, high = np.full(len(where), len(unit.ids)), np.full(len(where), -1)
        np.minimum.at(low, number, doc)
        np.maximum.at(high, number, doc)
        return U.ask(key[0].as_py(), buckets, h[where], None, low != high)

    def strings(key, table, replies):
        """Send the strings under the grams that others have, equal ones once."""
        me, unit = key[0].as_py(), _Unit(U.in_order(table), least)
        flags, _ = U.answers(replies)
        h = unit.hash
        if not len(h):
            return U.mail(me, np.zeros(0, np.int64), pa.array([], pa.large_binary()))
        _, number, _ = U.distinct(h, None, buckets)
        hot = flags[number]
        begin, count, doc, bucket = unit.at[hot], unit.count[hot], unit.doc[hot], U.bucket_of(h[hot], buckets)
        raw = unit.data.tobytes()
        seen: dict[bytes, int] = {}
        index, left, owner, where = np.empty(len(begin), np.int64), [], [], []
        for i, (b, n, d) in enumerate(zip(begin.tolist(), (count + least - 1).tolist(), doc.tolist())):
            before = raw[b - 1] if b > unit.offsets[d] else START
            k = seen.setdefault(raw[b: b + n], len(seen))
            index[i] = k
            if k == len(left):
                left.append(before)
                owner.append(unit.ids[d])  # rows come by id, so this is the smallest
                where.append(bucket[i])
            elif left[k] != before or before == START:
                left[k] = MIXED
        order = np.argsort(np.array(where, np.int64), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        text = list(seen)
        text = [text[k] for k in order]
        owner, left, where = np.array(owner, np.int64)[order], np.array(left, np.int16)[order], np.array(where, np.int64)[order]
        cuts = np.flatnonzero(np.diff(where, prepend=-1)).tolist() + [len(where)] if len(where) else [0]
        blobs = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            size = np.array([len(x) for x in text[a:b]], np.uint16)
            blobs.append(b"".join([np.uint32(b - a).tobytes(), owner[a:b].tobytes(), left[a:b].tobytes(), size.tobytes(), *text[a:b]]))
        # places rise along a unit, so what is kept of them are small steps
        memo = b"".join([
            np.array([len(text), len(begin)], np.int64).tobytes(), owner.tobytes(), np.array([len(x) - least + 1 for x in text], np.int32).tobytes(),
            *(np.asarray(x, np.int32).tobytes() for x in (np.diff(begin, prepend=0), np.diff(doc, prepend=0), place[index]))])
        return pa.concat_tables([U.note(me, memo), U.mail(me, where[cuts[:-1]], pa.array(blobs, pa.large_binary()))])

    def array(key, table):
        """The enhanced suffix array of a bucket."""
        if key[0].as_py() < 0:
            return table
        rows = [x.as_py() for x in U.flat(table["blob"])]
        owners, lefts, sizes, texts, held = [], [], [], [], []
        for blob in rows:
            n = int(np.frombuffer(blob, np.uint32, 1)[0])
            owners.append(np.frombuffer(blob, np.int64, n, 4))
            lefts.append(np.frombuffer(blob, np.int16, n, 4 + 8 * n))
            sizes.append(np.frombuffer(blob, np.uint16, n, 4 + 10 * n).astype(np.int64))
            texts.append(np.frombuffer(blob, np.uint8, -1, 4 + 12 * n))
            held.append(n)
        all_owner, all_left, all_size, raw = *map(np.concatenate, (owners, lefts, sizes)), b"".join(x.tobytes() for x in texts)
        # equal strings of different units stand in the array once
        ends = np.cumsum(all_size)
        index: dict[bytes, int] = {}
        which = np.array([index.setdefault(raw[e - n: e], len(index)) for e, n in zip(ends.tolist(), all_size.tolist())], np.int64)
        size = np.array([len(x) for x in index], np.int64)
        owner, held_by = np.full(len(index), NO_ID), np.bincount(which)
        np.minimum.at(owner, which, all_owner)
        low, high = np.full(len(index), MIXED, np.int64), np.full(len(index), -1, np.int64)
        np.minimum.at(low, which, all_left)
        np.maximum.at(high, which, all_left)
        left = np.where((low == high) & ((high < START) | (held_by == 1)), high, MIXED)
        data = np.frombuffer(b"".join(index), np.uint8)
        count = size - least + 1
        first = np.cumsum(count) - count
        string = np.repeat(np.arange(len(size)), count)
        inner = np.arange(len(string)) - np.repeat(first, count)
        at = inner + np.repeat(np.cumsum(size) - size, count)
        rest = size[string] - inner
        wide = int(size.max())
        windows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(wide, np.uint8)), wide)
        own, hit = owner[string], np.zeros(len(at), bool)
        before = np.where(inner == 0, left[string], data[np.maximum(at - 1, 0)])
        found = []
        for part in _ranges(np.ascontiguousarray(windows[:, :8]).view(">u8").ravel()[at].astype(np.uint64)):
            suffix = windows[at[part]]
            suffix[np.arange(wide) >= rest[part][:, None]] = 0
            order = np.argsort(suffix.view(f"S{wide}").ravel(), kind="stable")
            suffix, part = suffix[order], part[order]
            lcp = np.append(0, np.minimum(_common(suffix), np.minimum(rest[part[1:]], rest[part[:-1]])))
            ids, prior = own[part], before[part]
            smallest = ids.copy()
            turn = np.append(0, np.cumsum((prior[1:] != prior[:-1]) | (prior[1:] >= START)))
            for lo, hi, length, root in _tree(lcp, least):
                if root:
                    smallest[lo: hi + 1] = ids[lo: hi + 1].min()
                # left-maximal, or the rest of it stands in another bucket
                if groups and (turn[hi] != turn[lo] or prior[lo] == MIXED):
                    found.append((_name(suffix[lo, :length]), length, part[lo: hi + 1]))
            if groups:  # a string held often is a group of its own, unless an interval of its length has it
                wider = np.maximum(lcp, np.append(lcp[1:], 0))
                for i in np.flatnonzero((prior == MIXED) & (wider < rest[part])):
                    length = int(rest[part[i]])
                    found.append((_name(suffix[i, :length]), length, part[i: i + 1]))
            hit[part] = smallest < ids
        all_count = all_size - least + 1
        place = np.repeat(first[which], all_count) + np.arange(all_count.sum()) - np.repeat(np.cumsum(all_count) - all_count, all_count)
        hit = hit[place] | np.repeat(all_owner > owner[which], all_count)
        row_of = np.repeat(np.arange(len(held)), held)
        ends = np.cumsum(np.bincount(row_of, weights=all_count, minlength=len(held)).astype(np.int64))
        starts = np.append(0, ends[:-1])
        blobs = [np.uint32(b - a).tobytes() + np.packbits(hit[a:b]).tobytes() for a, b in zip(starts, ends)]
        if groups:
            begin = np.cumsum(all_count) - all_count
            holders: dict[int, list[int]] = {}
            for j, k in enumerate(which.tolist()):
                holders.setdefault(k, []).append(j)
            extra: list[list] = [[] for _ in rows]
            for name, length, members in found:
                for w in members.tolist():
                    for j in holders[int(string[w])]:
                        extra[row_of[j]].append((name, length, begin[j] + inner[w] - starts[row_of[j]]))
            blobs = [x + np.array(e, np.int64).tobytes() for x, e in zip(blobs, extra)]
        return pa.table({"_unit": table["_unit"], "bucket": table["bucket"], "blob": pa.array(blobs, pa.binary())})

    asked = dealt.rows.groupBy("_unit").applyInArrow(anchors, U.MAIL)
    told = asked.groupBy("bucket").applyInArrow(U.answer(4), U.MAIL)
    sent = dealt.rows.groupBy("_unit").cogroup(told.groupBy("_unit")).applyInArrow(strings, U.MAIL)
    return dealt, sent.groupBy("bucket").applyInArrow(array, U.MAIL)


def _common(suffix: np.ndarray) -> np.ndarray:
    """Bytes that neighbouring rows have in common at their beginning."""
    same = suffix[1:] == suffix[:-1]
    return np.where(same.all(axis=1), suffix.shape[1], np.argmin(same, axis=1))


def _tree(lcp: np.ndarray, least: int):
    """intervals() over each stretch of the array where neighbours have `least` in common."""
    near = lcp >= least
    near[0] = False
    edge = np.flatnonzero(np.diff(near.astype(np.int8), prepend=0, append=0))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        for lo, hi, length, root in intervals([0, *lcp[a:b].tolist()], least):
            yield a - 1 + lo, a - 1 + hi, length, root


def _ranges(prefix: np.ndarray, size: int = 1 << 16):
    """Ranges of the suffix array by leading bytes, of about `size` suffixes; one
    prefix is never split."""
    order = np.argsort(prefix, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(prefix[order])) + 1, len(order))
    at = 0
    while at < len(order):
        to = int(cuts[min(np.searchsorted(cuts, at + size), len(cuts) - 1)])
        yield order[at:to]
        at = to


def _name(text: np.ndarray) -> int:
    return int(U.span_hashes(text.astype(np.uint64) + np.uint64(1), np.array([0]), np.array([len(text)])).view(np.int64)[0])


def _memo(notes: list[bytes]):
    n, m = np.frombuffer(notes[0], np.int64, 2).tolist()
    owner = np.frombuffer(notes[0], np.int64, n, 16)
    rest = np.frombuffer(notes[0], np.int32, -1, 16 + 8 * n).astype(np.int64)
    windows, (begin, doc, place) = rest[:n], rest[n:].reshape(3, m)
    return windows, owner, np.cumsum(begin), np.cumsum(doc), place


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 50) -> DataFrame:
    """Remove every byte covered by a string of min_bytes bytes that also starts
    in a document with a smaller id. Texts are taken as UTF-8.

    A suffix array over all texts would live in one place. So positions are dealt
    out by the least 16-byte gram of the window that starts there: equal windows
    have equal least grams and meet in one bucket. Grams that one document alone
    has are left out beforehand. Each bucket sorts the suffixes of the strings it
    got, computes common prefixes and scans them with a stack; the intervals of
    the tree name all occurrences of a repeat at once, and the smallest id among
    them decides. A string that one unit holds often is sent once.

    Ids are whole numbers; a null id counts as larger than all others. Rows that
    share an id do not remove each other's bytes. A null text is empty. Other
    columns are not read. Each row gives one row.

    Returns id, n_bytes, n_removed, spans (start, length in bytes), kept (the
    remaining bytes; they need not be valid UTF-8, since a cut may split a character).
    """
    dealt, replies = suffix_mail(docs, id_col, text_col, min_bytes, False)

    def cut(key, table, back):
        table = U.in_order(table)
        data, offsets = U.text_bytes(table["text"])
        gone = np.zeros(len(data), bool)
        flags, notes = U.answers(back)
        if notes:
            ids = U.flat(table["id"]).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            windows, owner, begin, doc, place = _memo(notes)
            at = np.cumsum(windows) - windows
            count = windows[place]
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            later = np.repeat(ids[doc] > owner[place], count)
            hit = later | flags[np.repeat(at[place], count) + inner]
            gone = U.covered(len(data), (np.repeat(begin, count) + inner)[hit], min_bytes)
        starts, ends = U.runs(gone, offsets)
        sums = np.append(0, np.cumsum(~gone))
        return pa.table({
            "id": table["id"], "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(np.diff(offsets) - np.diff(sums[offsets]), pa.int64()),
            "spans": U.span_lists(starts, ends, offsets), "kept": U.binaries(data[~gone], sums[offsets]).cast(pa.binary()),
        })

    out = dealt.rows.groupBy("_unit").cogroup(replies.groupBy("_unit")).applyInArrow(cut, f"id long, n_bytes long, n_removed long, spans {U.SPANS}, kept binary")
    return out.withColumnRenamed("id", id_col)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 50) -> DataFrame:
    """Maximal repeats with all their occurrences, one row per occurrence:
    group_id (a hash of the string), length, id, start (in bytes).

    A group is an interval of the tree whose occurrences differ in the byte before
    them. Strings are cut where the least gram changes, so a repeat longer than
    about twice min_bytes appears as consecutive, overlapping groups. Only repeats
    that two documents share are listed. Nulls and ties as in suffix_dedup.
    """
    dealt, replies = suffix_mail(docs, id_col, text_col, min_bytes, True)

    def expand(key, table, back):
        table = U.in_order(table)
        _, offsets = U.text_bytes(table["text"])
        bucket = U.flat(back["bucket"]).to_numpy(zero_copy_only=False)
        blobs = [U.flat(back["blob"])[int(i)].as_py() for i in np.argsort(bucket, kind="stable")]
        rows = []
        if bucket.size and bucket.min() < 0:
            windows, _, begin, doc, place = _memo(blobs[:1])
            at = np.cumsum(windows) - windows
            by_string: dict[int, list[int]] = {}
            for i, p in enumerate(place.tolist()):
                by_string.setdefault(p, []).append(i)
            done = 0
            for blob in blobs[1:]:
                n = int(np.frombuffer(blob, np.uint32, 1)[0])
                for name, length, window in np.frombuffer(blob[4 + (n + 7) // 8:], np.int64).reshape(-1, 3).tolist():
                    p = int(np.searchsorted(at, done + window, side="right")) - 1
                    for i in by_string[p]:
                        rows.append((name, length, int(doc[i]), int(begin[i] + done + window - at[p] - offsets[doc[i]])))
                done += n
        name, length, who, start = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 4
        return pa.table({"group_id": name, "length": length, "id": table["id"].take(pa.array(who)), "start": start})

    out = dealt.rows.groupBy("_unit").cogroup(replies.groupBy("_unit")).applyInArrow(expand, "group_id long, length long, id long, start long")
    return out.distinct().withColumnRenamed("id", id_col)

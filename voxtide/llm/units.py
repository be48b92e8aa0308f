"""Documents dealt into units of a bounded number of bytes, and questions that
units ask each other.

A unit holds whole rows and is the group in which numpy works. To learn which of
its hashes other units hold too, a unit sends them out as packed blobs, one row
per bucket of the hash space; a bucket compares what it got and answers every
sender with one bit per hash. The shuffle of the texts by unit is planned once
and reused by every step of one plan (Spark's exchange reuse), so texts travel
once however many rounds a method takes.

A hash that fills a third of the table is sent once per unit, not once per row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT_BYTES = 2 << 20
MAIL = "_unit long, bucket long, blob binary"


@dataclass(frozen=True)
class Units:
    rows: DataFrame      # id, text, _unit
    n: int
    buckets: int
    id_type: str


def deal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT_BYTES, carry: tuple[str, ...] = ()) -> Units:
    """One job counts the bytes; the number of units follows from them. Rows with
    one id and one text share a unit, rows without an id are spread by text.
    Columns to carry along go by c0, c1, ..., so no name clashes."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       *[docs[c].alias(f"c{i}") for i, c in enumerate(carry)])
    n_bytes, = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")) + 64)).first()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = (n_bytes or 0) // unit_bytes + 1
    n = max(sized, 8 * parts)
    # a unit writes to every bucket: with little data in many units, fewer buckets keep each letter worth sending
    buckets = max(sized, min(parts, (n_bytes or 0) // (1000 * n)))
    return Units(rows.withColumn("_unit", F.pmod(F.xxhash64("id", "text"), F.lit(n))), n, buckets, docs.schema[id_col].dataType.simpleString())


def flat(column) -> pa.Array:
    """One contiguous array of a table's column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def in_order(table: pa.Table) -> pa.Table:
    """The rows of a unit in an order that does not depend on how the shuffle
    delivered them. Equal rows are interchangeable."""
    return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")])) if table.num_rows > 1 else table


def text_bytes(texts, tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array with `tail` after each, and n + 1 offsets."""
    texts = pc.fill_null(flat(texts).cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    if tail:
        end = pa.scalar(tail, pa.large_binary())
        texts = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), end) if len(texts) else texts
    texts = flat(texts)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]: offsets[-1]], offsets - offsets[0]


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A large_binary array over one buffer."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string array over one buffer of valid UTF-8."""
    return binaries(data, offsets).cast(pa.binary()).cast(pa.string())


# ---- hashing -----------------------------------------------------------------

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q1, _Q2 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd."""
    kept = _POWERS.get(int(base))
    if kept is None or len(kept[0]) < n:
        size = max(1 << 16, int(n * 1.1))
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        kept = []
        for b in (base, inverse):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            kept.append(np.multiply.accumulate(row))
        _POWERS[int(base)] = kept = tuple(kept)
    return kept[0][:n], kept[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _R) -> np.ndarray:
    """64-bit hashes of values[start:end]; equal spans of equal length hash alike."""
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def window_hashes(words: np.ndarray, length: int, second: bool = False) -> np.ndarray:
    """Hashes of all runs of `length` consecutive 64-bit values, by start."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return span_hashes(words, starts, starts + length, _Q2 if second else _Q1)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@dataclass
class Words:
    data: np.ndarray     # bytes of all texts, a space after each
    offsets: np.ndarray  # of the texts
    starts: np.ndarray   # of the words
    ends: np.ndarray
    first: np.ndarray    # word number at which each text begins, n + 1 entries

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends)

    def inside(self, length: int) -> np.ndarray:
        """Whether the window that starts at a word ends in the same text."""
        n = len(self.starts) - length + 1
        if n <= 0:
            return np.zeros(0, bool)
        ok = np.ones(n, bool)
        # a window that starts less than `length` words before the next text crosses over
        for back in range(1, length):
            at = self.first[1:] - back
            at = at[(at >= self.first[:-1]) & (at < n)]
            ok[at] = False
        return ok


def words_of(texts) -> Words:
    """The words [^\\x20\\x09-\\x0D]+ of every text."""
    data, offsets = text_bytes(texts, b" ")
    space = _SPACE[data]
    edge = np.empty(len(data), bool)
    if len(data):
        edge[0] = not space[0]
        np.logical_and(space[:-1], ~space[1:], out=edge[1:])
    starts = np.flatnonzero(edge)
    if len(data):
        edge[0] = False
        np.logical_and(~space[:-1], space[1:], out=edge[1:])
    ends = np.flatnonzero(edge)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


# ---- questions between units ---------------------------------------------------

def ask(unit: int, buckets: int, h1: np.ndarray, h2: np.ndarray | None, twice: np.ndarray) -> pa.Table:
    """Mail with the distinct hashes of a unit, sorted as `distinct` sorts them.

    Where h2 is None a hash is cut to its bucket and 31 bits: enough to thin out
    candidates, since a bucket holds a bounded number of hashes. With h2 all 128
    bits go. `twice` says that the unit alone has the hash more than once.
    """
    bucket = bucket_of(h1, buckets)
    if h2 is None:
        body = ((h1 & np.uint64(0x7FFFFFFF)).astype(np.uint32) << np.uint32(1)) | twice.astype(np.uint32)
        body, width = body.view(np.uint8), 4
    else:
        body = np.empty((len(h1), 2), np.uint64)
        body[:, 0] = h1
        body[:, 1] = (h2 & ~np.uint64(1)) | twice.astype(np.uint64)
        body, width = body.reshape(-1).view(np.uint8), 16
    edges = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    return mail(unit, bucket[edges], binaries(body, np.append(edges, len(bucket)) * width) if len(edges) else pa.array([], pa.large_binary()))


def mail(unit: int, bucket: np.ndarray, blobs: pa.Array) -> pa.Table:
    return pa.table({
        "_unit": pa.array(np.full(len(bucket), unit, np.int64)), "bucket": pa.array(np.asarray(bucket, np.int64)), "blob": blobs.cast(pa.binary()),
    })


def note(unit: int, blob: bytes) -> pa.Table:
    """Mail of a unit to itself: its bucket is below zero and no other unit writes there."""
    return mail(unit, np.array([-1 - unit]), pa.array([blob], pa.large_binary()))


def bucket_of(h1: np.ndarray, buckets: int) -> np.ndarray:
    return (((h1 >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def distinct(h1: np.ndarray, h2: np.ndarray | None, buckets: int):
    """(where each distinct hash stands first, number of it per entry, counts),
    in bucket order. Without h2 hashes count as equal as `ask` cuts them."""
    if h2 is None:
        key = (bucket_of(h1, buckets) << 31) | (h1 & np.uint64(0x7FFFFFFF)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.diff(key, prepend=-1) != 0
    else:
        order = np.lexsort((h2 | np.uint64(1), h1))
        a, b = h1[order], h2[order] | np.uint64(1)
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[at], number, np.diff(np.append(at, len(order)))


def answer(width: int):
    """For a bucket: one bit per hash received, whether it stands in two units or
    twice in one. Rows below zero are notes and pass."""
    def run(key, table):
        if key[0].as_py() < 0:
            return table
        data, offsets = text_bytes(table["blob"])
        at = offsets // width
        if width == 4:
            value = data.view(np.uint32) if data.flags.aligned else np.frombuffer(data.tobytes(), np.uint32)
            order = np.argsort(value, kind="stable")
            value = value[order]
            same, own = (value[1:] >> 1) == (value[:-1] >> 1), (value & 1).astype(bool)
        else:
            value = np.frombuffer(data.tobytes(), np.uint64).reshape(-1, 2)
            order = np.lexsort((value[:, 1], value[:, 0]))
            value = value[order]
            same = (value[1:, 0] == value[:-1, 0]) & ((value[1:, 1] | np.uint64(1)) == (value[:-1, 1] | np.uint64(1)))
            own = (value[:, 1] & np.uint64(1)).astype(bool)
        hit = own.copy()
        hit[1:] |= same
        hit[:-1] |= same
        # a hash seen twice by one unit is alone in the bucket or next to its equals, so both ways are covered
        flags = np.empty(len(order), bool)
        flags[order] = hit
        bits = [np.packbits(flags[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
        sizes = np.diff(at).astype(np.uint32)
        blobs = pa.array([n.tobytes() + x for n, x in zip(sizes, bits)], pa.binary())
        return pa.table({"_unit": table["_unit"], "bucket": table["bucket"], "blob": blobs})
    return run


def answers(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """What a unit gets back: the bits in the order of `distinct`, and its notes."""
    bucket = flat(table["bucket"]).to_numpy(zero_copy_only=False)
    blobs = flat(table["blob"])
    flags, notes = [], []
    for i in np.argsort(bucket, kind="stable"):
        blob = blobs[int(i)].as_py()
        if bucket[i] < 0:
            notes.append(blob)
        else:
            n = int(np.frombuffer(blob[:4], np.uint32)[0])
            flags.append(np.unpackbits(np.frombuffer(blob, np.uint8, offset=4), count=n))
    return (np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)), notes


def covered(n: int, starts: np.ndarray, length) -> np.ndarray:
    """Which of n places lie in [start, start + length) for some start."""
    depth = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    return np.cumsum(depth)[:n] > 0


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross a bound."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(mask) + 1, bool)
    cut[bounds] = True
    begins = mask & (~np.append(False, mask[:-1]) | cut[:-1])
    stops = mask & (~np.append(mask[1:], False) | cut[1:])
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def span_lists(starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """A list of (start, length) per text; positions count from the text's beginning."""
    at = np.searchsorted(starts, first)
    text = np.searchsorted(first, starts, side="right") - 1
    rows = pa.StructArray.from_arrays([pa.array(starts - first[text], pa.int64()), pa.array(ends - starts, pa.int64())], names=["start", "length"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows)


SPANS = "array<struct<start: bigint, length: bigint>>"

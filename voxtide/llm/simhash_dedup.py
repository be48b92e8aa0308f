"""SimHash fingerprints, linked through deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.llm import units as U
from voxtide.operators.skew import attach_lookup
from voxtide.session import cut_lineage

BITS = 64
SEED = 42


def simhash(text: bytes, shingle: int = 4) -> bytes:
    """64 bits, big-endian: those set in over half the shingles' hashes."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return bytes(8)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    starts = np.append(0, gaps + 1).tolist()
    ends = np.append(gaps, len(norm)).tolist()
    digest = xxhash.xxh64_digest
    if len(starts) <= shingle:
        return digest(norm, SEED)
    hashes = b"".join([digest(norm[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])])
    n = len(hashes) // 8
    ones = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id, th (a hash of the text) and fingerprint (as a signed long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = b"".join([simhash((x.as_py() or "").encode(), shingle) for x in batch["text"]])
            yield pa.record_batch({"id": batch["id"], "th": batch["th"], "fingerprint": pa.array(np.frombuffer(marks, ">i8").astype(np.int64))})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, th long, fingerprint long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the fewest segments of which one is sure to differ in
    at most one bit when the whole differs in at most `distance`."""
    n = max(1, (distance + 2) // 2)
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def variants(marks: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """(variant number, the segment with one bit left open) for every segment and bit."""
    number = 0
    for first, size in segments(distance):
        part = (marks >> np.uint64(first)) & np.uint64((1 << size) - 1 if size < 64 else 0xFFFFFFFFFFFFFFFF)
        for bit in range(size):
            yield number, part & ~np.uint64(1 << bit)
            number += 1


def _linked(marks: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A forest that spans the links among the marks of one key: each mark is
    compared with those not yet reached, so no set of all pairs arises."""
    out, rest, queue = [], marks, []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        seed = queue.pop()
        near = np.bitwise_count(rest ^ seed) <= distance
        if near.any():
            found = rest[near]
            out.append((np.full(len(found), seed), found))
            queue.extend(found)
            rest = rest[~near]
    return out


SMALL = 32  # groups up to this size are compared side by side; larger ones one by one


def links(marks: DataFrame, distance: int) -> DataFrame:
    """Links (a < b) among distinct fingerprints (column fingerprint), enough of
    them to connect whatever differs in at most `distance` bits."""
    parts = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_variants = BITS
    buckets = max(parts, marks.count() * n_variants // 250_000 + 1)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["fingerprint"].to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(own), 4000):
                own_part = own[at: at + 4000]
                bucket = np.concatenate([U.bucket_of(U.mix(part | np.uint64(v << 48)), buckets) for v, part in variants(own_part, distance)])
                body = np.zeros(len(bucket), np.dtype([("mark", "<u8"), ("v", "u1")]))
                body["mark"] = np.tile(own_part, n_variants)
                body["v"] = np.repeat(np.arange(n_variants), len(own_part))
                order = np.argsort(bucket, kind="stable")
                bucket, body = bucket[order], body[order]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                blobs = U.binaries(body.view(np.uint8), np.append(cuts, len(bucket)) * body.itemsize)
                yield pa.record_batch({"bucket": pa.array(bucket[cuts]), "blob": blobs.cast(pa.binary())})

    def verify(key, table):
        body = np.frombuffer(U.text_bytes(table["blob"])[0].tobytes(), np.dtype([("mark", "<u8"), ("v", "u1")]))
        mark, v = body["mark"].astype(np.uint64), body["v"]
        part = np.zeros(len(mark), np.uint64)
        number = 0
        for first, size in segments(distance):
            low = np.uint64((1 << size) - 1)
            here = (v >= number) & (v < number + size)
            part[here] = ((mark[here] >> np.uint64(first)) & low) & ~(np.uint64(1) << (v[here] - number).astype(np.uint64))
            number += size
        order = np.lexsort((mark, part, v))
        mark, part, v = mark[order], part[order], v[order]
        new = np.ones(len(mark), bool)
        new[1:] = (part[1:] != part[:-1]) | (v[1:] != v[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(mark)))
        group = np.cumsum(new) - 1
        pairs = []
        left = np.flatnonzero((size[group] > 1) & (size[group] <= SMALL))
        for lag in range(1, SMALL):
            left = left[left + lag < len(mark)]
            left = left[group[left] == group[left + lag]]
            if not len(left):
                break
            near = np.bitwise_count(mark[left] ^ mark[left + lag]) <= distance
            pairs.append((mark[left[near]], mark[left[near] + lag]))
        for g in np.flatnonzero(size > SMALL):
            pairs.extend(_linked(mark[first[g]: first[g] + size[g]], distance))
        a = np.concatenate([x for x, _ in pairs]).view(np.int64) if pairs else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in pairs]).view(np.int64) if pairs else np.zeros(0, np.int64)
        low, high = np.minimum(a, b), np.maximum(a, b)
        both = np.unique(np.stack([low, high], axis=1), axis=0)
        return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1])})

    sent = marks.select("fingerprint").mapInArrow(index, "bucket long, blob binary")
    return sent.groupBy("bucket").applyInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected with) for every node of the
    edges (a, b). Large-star and small-star steps take turns until nothing
    changes; each round is written to the shared folder."""
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state(now)
    while before[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every edge now points down; hang all lower neighbours under the lowest
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        hung = large.join(low, large.a == low.n).select("a", "b", "m")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hung.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = cut_lineage(small)
        after = state(now)
        if after == before:
            break
        before = after
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.union(ends.select(F.col("root").alias("node"), "root").distinct())


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """Near-duplicate classes by SimHash: fingerprints link where they differ in
    at most `distance` bits, and classes are what links connect.

    Fingerprints are cut into the fewest segments of which one differs in at most
    one bit (three for four bits). For every segment and every bit of it a variant
    with that bit left open is an index key; fingerprints that share a key are
    compared exactly. Equal fingerprints are one before any of this, and within a
    key a spanning forest of links is kept instead of all pairs, so a group of
    copies of any size gives a number of rows in proportion.

    Texts: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles with repeats; fewer
    words than a shingle make one shingle; no word (null, empty) gives fingerprint
    zero, linked like any other. Repeated rows and ids are separate rows. A null id
    never is a component's smallest id; a component of null ids only has none.

    Returns id, th (xxhash64 of the text), fingerprint (signed long), root (the
    smallest fingerprint of the component), component_id (smallest id). The
    fingerprints are computed when this is called and kept in the shared folder.
    """
    marks = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    classes = cut_lineage(marks.groupBy("fingerprint").agg(F.min("id").alias("least")))
    roots = components(links(classes, distance))
    named = classes.join(roots, classes.fingerprint == roots.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    lookup = cut_lineage(named.join(smallest, F.col("root") == F.col("r")).select("fingerprint", "root", "component_id"))
    return attach_lookup(marks, lookup, "fingerprint", ["root", "component_id"]).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4) -> DataFrame:
    """The rows of docs, with all their columns, that stand first in their class:
    the smallest id (null after all others), then the smallest hash of the text. Of
    rows equal in id and text one stays. Other cases as in simhash_dedup."""
    last = F.lit((1 << 63) - 1)
    marks = simhash_dedup(docs, id_col, text_col, shingle, distance)
    firsts = marks.groupBy("root").agg(F.min(F.struct(F.coalesce(id_col, last).alias("i"), F.col("th").alias("t"))).alias("f")).select("f.i", "f.t")
    # names of the columns are set aside, so that none clashes
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)],
                       F.coalesce(F.col(id_col).cast("long"), last).alias("_i"), F.xxhash64(F.col(text_col).cast("string")).alias("_t"))
    kept = rows.join(firsts, (F.col("_i") == F.col("i")) & (F.col("_t") == F.col("t")), "left_semi").dropDuplicates(["_i", "_t"])
    return kept.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)])

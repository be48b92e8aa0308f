"""Exact token counts of every prefix of a text, by dynamic programming."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How byte-level BPE vocabularies split a text, and the bytes that
# stand for themselves in their files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

CACHE_PIECES = 400_000  # of each of two generations


def _byte_names() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts for one vocabulary file.

    Of a piece (what the split pattern gives) the encoding of every prefix ends in
    exactly one token, and two tokens may follow each other only if encoding them
    together gives both back. So the last token of a prefix is the one that ends
    there and may follow the last token of what is before it, and its count is one
    more than the count there. Answers for pairs and pieces are remembered, in
    tables of bounded size.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        names = _byte_names()
        raw = lambda token: bytes(names[c] for c in token)
        special = {t["content"] for t in model["added_tokens"]}
        self.vocab = {raw(t): i for t, i in model["model"]["vocab"].items() if t not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> rank of its merge, left part, right part
        for i, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            key = self.vocab[a], self.vocab[b]
            self.rank[key] = i
            self.made.setdefault(self.vocab[a + b], (i, *key))
        self.longest = max(map(len, self.vocab))
        self.split = regex.compile(SPLIT)
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, tuple[int, bytes]] = {}
        self.older: dict[str, tuple[int, bytes]] = {}

    def _apart(self, a: int, b: int) -> bool:
        """Whether encoding the texts of two tokens together gives both back.

        The merges that make a and b are undone, the latest first (of equal ones the
        right one, since the left is made first). In between, the parts that meet at
        the seam must not merge before the next step on either side: a merge of equal
        rank on the left comes first, one on the right comes after."""
        byte = (-1, 0, 0)
        ahead_a = ahead_b = len(self.rank)
        while True:
            meets = self.rank.get((a, b))
            if meets is not None and meets < ahead_a and meets <= ahead_b:
                return False
            made_a, made_b = self.made.get(a, byte), self.made.get(b, byte)
            if made_a[0] < 0 and made_b[0] < 0:
                return True
            if made_a[0] > made_b[0]:
                ahead_a, a = made_a[0], made_a[2]
            else:
                ahead_b, b = made_b[0], made_b[1]

    def prefixes(self, data: bytes) -> list[int]:
        """Counts of data[:0], data[:1], ..., data."""
        count, last, vocab, pairs, longest = [0], [-1], self.vocab, self.pairs, self.longest
        for end in range(1, len(data) + 1):
            for start in range(end - 1, (end - longest if end > longest else 0) - 1, -1):
                token = vocab.get(data[start: end])
                if token is None:
                    continue
                if start:
                    key = last[start], token
                    follows = pairs.get(key)
                    if follows is None:
                        if len(pairs) > 2 * CACHE_PIECES:
                            pairs.clear()
                        follows = pairs[key] = self._apart(*key)
                    if not follows:
                        continue
                count.append(count[start] + 1)
                last.append(token)
                break
        return count

    def piece(self, text: str) -> tuple[int, bytes]:
        """Count of a piece, and what each of its characters adds (int16)."""
        known = self.pieces.get(text)
        if known is None:
            known = self.older.get(text)
            if known is None:
                known = self._count_piece(text)
            if len(self.pieces) > CACHE_PIECES:  # what is used again moves on to the next generation
                self.pieces, self.older = {}, self.pieces
            self.pieces[text] = known
        return known

    def _count_piece(self, text: str) -> tuple[int, bytes]:
        data = text.encode()
        counts = self.prefixes(data)
        if text in CONTRACTIONS and len(text) > 2:  # cut short, it is an apostrophe and a letter
            counts[2] = 2
        if len(data) != len(text):  # prefixes end where characters do
            counts = [counts[0], *(counts[i] for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80)]
        return counts[-1], array("h", map(int.__sub__, counts[1:], counts)).tobytes()

    def plain(self, text: str) -> tuple[int, list[bytes]]:
        """Count and steps of a text without special tokens."""
        total, steps, spaces = 0, [], None
        for piece in self.split.findall(text):
            n, step = self.pieces.get(piece) or self.piece(piece)
            if spaces is not None and piece[0].isspace():
                # as long as the text ended here, this character belonged to the run of white space
                run, before, done = spaces
                k = 1 if not piece.isspace() else len(piece)
                whole = np.frombuffer(self.piece(run + piece[:k])[1], "<i2").astype(np.int64)
                own = np.frombuffer(step, "<i2").astype(np.int64)
                level = np.cumsum(whole)[len(run):]  # counts since the run began
                counts = np.append(before + level, total + np.cumsum(own)[k:])
                step = np.diff(counts, prepend=done).astype("<i2").tobytes()
                done = int(counts[-1])
                total += n
                if piece.isspace():
                    # what is stored ends where the run would end; the next step starts from there
                    spaces = (run + piece, before, done)
                else:
                    spaces = None
            else:
                if spaces is not None and spaces[2] != total:
                    shift = np.frombuffer(step, "<i2").copy()
                    shift[0] += total - spaces[2]
                    step = shift.tobytes()
                spaces = (piece, total, total + n) if piece.isspace() else None
                total += n
            steps.append(step)
        if spaces is not None and spaces[2] != total:
            total = spaces[2]
        return total, steps

    def count(self, text: str) -> tuple[int, bytes]:
        """Count of a text, and what each character adds to the count of the
        prefix that ends with it (little-endian int16; can be negative)."""
        if self.special is None or not self.special.search(text):
            total, steps = self.plain(text)
            return total, b"".join(steps)
        total, steps, at = 0, [], 0
        for found in self.special.finditer(text):
            n, own = self.plain(text[at: found.start()])
            steps += own
            # inside a special string the prefix is ordinary text
            partial = [self.plain(text[at: found.start() + k])[0] for k in range(1, len(found[0]))]
            steps.append(np.diff([n, *partial, n + 1]).astype("<i2").tobytes())
            total, at = total + n + 1, found.end()
        n, own = self.plain(text[at:])
        return total + n, b"".join(steps + own)


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One per Python worker and file."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_chars, n_tokens and steps of every row, with the byte-level
    BPE vocabulary in `path` (a file every executor has).

    steps holds, for each character, by how much it changes the token count of the
    prefix that ends with it, as the library would count that prefix: the sum of
    the first k is the count of the first k characters. It is filled by dynamic
    programming over the prefixes of each piece, so nothing is encoded anew for a
    question about a prefix. Special strings in a text count as one token.

    Whole texts, no truncation. A null or empty text has 0 of everything. Each row
    gives one row, whatever its id; other columns are not read. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path).count
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part["text"].to_pylist()]
                found = [counts(x) for x in texts]
                yield pa.record_batch({
                    "id": part["id"], "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()), "n_chars": pa.array(list(map(len, texts)), pa.int64()),
                    "n_tokens": pa.array([n for n, _ in found], pa.int64()), "steps": pa.array([s for _, s in found], pa.binary()),
                })

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_chars long, n_tokens long, steps binary").withColumnRenamed("id", id_col)


def tokens_at(steps: Column | str, chars: Column | str) -> Column:
    """Token count of the prefix of so many characters, from the stored steps."""
    @F.pandas_udf("long")
    def at(steps, chars):  # noqa: ANN001
        import pandas as pd

        return pd.Series([int(np.frombuffer(s, "<i2", min(max(int(k), 0), len(s) // 2)).sum(dtype=np.int64)) for s, k in zip(steps, chars)])

    return at(steps, chars)


def chars_within(steps: Column | str, budget: Column | str) -> Column:
    """The longest prefix, in characters, that has at most so many tokens."""
    @F.pandas_udf("long")
    def within(steps, budget):  # noqa: ANN001
        import pandas as pd

        out = []
        for s, most in zip(steps, budget):
            counts = np.append(0, np.cumsum(np.frombuffer(s, "<i2"), dtype=np.int64))
            fits = np.flatnonzero(counts <= most)
            out.append(int(fits[-1]) if len(fits) else 0)
        return pd.Series(out)

    return within(steps, budget)

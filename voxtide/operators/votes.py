"""Weighted votes of tokens for classes, summed inside the row.

Tokens outside the vocabulary are dropped by a hash-set test, the weights of the
rest are whole numbers and are added up by a higher-order function. Nothing is
exploded, joined or shuffled, and rows that share a key stay rows of their own.
Vocabularies too large for a plan are tables that the words are joined with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtide.session import cut_lineage

MAX_BROADCAST_ROWS = 200_000


def small_table(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint behind a size check: a count of at most limit + 1 rows
    decides, and beyond the limit the join is left to shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def numbered(df: DataFrame) -> DataFrame:
    """df plus `_row`, a number per row, kept in the shared folder: the numbers stay the
    same however often the rows are read."""
    return cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))


#: Rows that ask for their words together.
BLOCK_BITS = 10


def asked(rows: DataFrame, words: str) -> DataFrame:
    """_block and _word: the distinct words of blocks of numbered rows. A block that
    stands in two Arrow batches may ask for a word twice."""
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("_words")
            n = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
            pairs = pa.table({"_block": np.repeat(batch.column("_block").to_numpy(), n), "_word": pc.list_flatten(listed)})
            yield from pairs.group_by(["_block", "_word"], use_threads=False).aggregate([]).select(["_block", "_word"]).to_batches()

    return rows.select(F.shiftright("_row", BLOCK_BITS).alias("_block"), F.col(words).alias("_words")).mapInArrow(distinct, "_block long, _word string")


def looked_up(rows: DataFrame, words: str, lexicon: DataFrame, payload: list[str], out: T.StructType,
              then: Callable[[pa.Table, np.ndarray, np.ndarray, pa.Table], pa.Table]) -> DataFrame:
    """What `then` makes of numbered rows and those of their words (an array column) that
    stand in a lexicon (term, payload) of any size with one row per term. It gets a block of
    rows, and of each known word, by row and place: the row's number in the block, the place
    among all words of the block, and the payload.

    Rows of neighbouring numbers are a block. A block asks for each of its words once, so
    a frequent word has one row per block in the join, and what travels are a block's
    distinct words and each row once."""
    known = asked(rows, words).join(lexicon.select(F.col("term").alias("_word"), *payload), "_word")

    def fill(block: pa.Table, known: pa.Table) -> pa.Table:
        listed = block.column(words).combine_chunks()
        n = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
        at = pc.index_in(pc.list_flatten(listed), value_set=known.column("_word").combine_chunks())
        places = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
        return then(block, np.repeat(np.arange(len(n)), n)[places], places, known.select(payload).take(at.drop_null()))

    blocks = rows.withColumn("_block", F.shiftright("_row", BLOCK_BITS))
    return blocks.groupBy("_block").cogroup(known.groupBy("_block")).applyInArrow(fill, out)


def table_votes(df: DataFrame, tokens: Column, keys: list[str], weights: DataFrame) -> DataFrame:
    """token_votes for a table (term, v0..vn-1) of any size, one row per term, as columns
    of the table's names, looked up by blocks. Rows that share a key stay rows of their own."""
    names = [c for c in weights.columns if c != "term"]
    rows = numbered(df.select(*keys, F.coalesce(tokens, F.array().cast("array<string>")).alias("_toks")))
    out = T.StructType([*rows.select(*keys).schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    def sums(block: pa.Table, row: np.ndarray, places: np.ndarray, votes: pa.Table) -> pa.Table:
        found = block.select(keys)
        for n in names:
            total = np.zeros(block.num_rows, np.int64)
            np.add.at(total, row, votes.column(n).to_numpy())
            found = found.append_column(n, pa.array(total))
        return found

    return looked_up(rows, "_toks", weights.select("term", *[F.coalesce(F.col(n).cast("bigint"), F.lit(0)).alias(n) for n in names]), names, out, sums)


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def fixed_map(values: dict[str, str]) -> Column:
    """A map of strings as two literals, for tables of thousands of entries: Spark
    makes the map once, while the plan is made."""
    pairs = "\x1e".join(f"{k}\x1f{v}" for k, v in values.items())
    return F.str_to_map(F.lit(pairs), F.lit("\x1e"), F.lit("\x1f"))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value, as one expression that holds the value once however often `then`
    names it. Spark copies a column's expression to every place that names it when it moves
    a filter below the projection; inside a lambda the copies are computed per element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def token_votes(df: DataFrame, tokens: Column, keys: list[str], weights: dict[str, dict[str, int]]) -> DataFrame:
    """keys plus `votes`: summed weights of the row's tokens by class; no hit gives zeros."""
    terms = sorted({t for w in weights.values() for t in w})

    def votes(hits: Column, own: dict[str, int]) -> Column:
        table = literal_map({t: own.get(t, 0) for t in terms})
        return F.aggregate(hits, F.lit(0).cast("long"), lambda acc, t: acc + F.element_at(table, t).cast("long"))

    hits = F.filter(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: t.isin(terms))
    return df.select(*keys, once(hits, lambda h: F.array(*[votes(h, own) for own in weights.values()])).alias("votes"))


def votes_array(n: int) -> Column:
    return F.array(*[F.col(f"v{i}") for i in range(n)])


def softmax(scores: Column) -> Column:
    """Softmax over an array of doubles."""
    def shares(exps: Column) -> Column:
        return once(F.aggregate(exps, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(exps, lambda e: e / total))

    return once(scores, lambda s: once(F.array_max(s), lambda top: once(F.transform(s, lambda x: F.exp(x - top)), shares)))


def argmax(scores: Column) -> Column:
    """Index of the largest value, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")

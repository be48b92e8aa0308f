"""Joins and per-key picks that hold when one key owns a large share of rows.

Two bounds are used everywhere instead of guesses about the data:

* at most HOT_KEYS rows are broadcast, whatever the input size. A key outside
  the HOT_KEYS heaviest ones owns less than 1/HOT_KEYS of all rows, so what is
  left for the shuffle is even enough for ordinary (or AQE-split) partitions;
* only fixed-width columns (longs, hashes, flags) ride in such a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HOT_KEYS = 1000
SPREAD = 4096


def heaviest(stats: DataFrame, keys: list[str], count: str, n: int = HOT_KEYS) -> DataFrame:
    """The n keys with most rows, from a one-row-per-key table with a count column."""
    return stats.orderBy(F.desc(count), *keys).limit(n)


def attach_stats(rows: DataFrame, stats: DataFrame, keys: list[str], payload: list[str],
                 count: str, spread_by: Column) -> DataFrame:
    """rows LEFT JOIN stats USING (keys), where a few keys may own most of rows.

    `stats` has one row per key with its row count and fixed-width payload.
    """
    return _attach(rows, heaviest(stats, keys, count), stats, keys, payload, spread_by, F.col(count) < 0)


def attach_lookup(rows: DataFrame, lookup: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """rows LEFT JOIN lookup USING (key) for a lookup with one row per key and
    short values; the heaviest keys are found by counting rows."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = lookup.join(F.broadcast(heaviest(counts, [key], "_n")), key)
    return _attach(rows, hot, lookup, [key], payload, F.xxhash64(*rows.columns), F.isnull(key))


def _attach(rows: DataFrame, hot: DataFrame, stats: DataFrame, keys: list[str], payload: list[str],
            spread_by: Column, never: Column) -> DataFrame:
    """Rows of the heaviest keys get their payload from a broadcast of at most
    HOT_KEYS rows; in the shuffled join those rows carry a spread number, so they
    scatter over the partitions instead of meeting in one. Rows without a key
    scatter too. `never` is a condition on stats that holds for no row.
    """
    hot = hot.select(
        *[F.col(k).alias(f"_h_{k}") for k in keys],
        *[F.col(p).alias(f"_hp_{p}") for p in payload],
        F.lit(True).alias("_hot"),
    )
    on_hot = [F.col(k) == F.col(f"_h_{k}") for k in keys]
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    tagged = (
        rows.join(F.broadcast(hot), on_hot, "left")
        .withColumn("_spread", F.when(F.col("_hot") | no_key, 1 + F.pmod(F.xxhash64(spread_by), F.lit(SPREAD))).otherwise(F.lit(0)))
    )
    cold = stats.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        *[F.col(p).alias(f"_cp_{p}") for p in payload],
        # zero for every row, but not a literal: a literal would be folded out
        # of the join keys and the hot rows would meet again
        F.when(never, 1).otherwise(0).cast("long").alias("_c_spread"),
    )
    on_cold = [F.col(k) == F.col(f"_c_{k}") for k in keys] + [F.col("_spread") == F.col("_c_spread")]
    joined = tagged.join(cold, on_cold, "left")
    return joined.select(
        *[c for c in rows.columns if c not in payload],
        *[F.when(F.col("_hot"), F.col(f"_hp_{p}")).otherwise(F.col(f"_cp_{p}")).alias(p) for p in payload],
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key. Spark trims each map task to one row per key
    before the shuffle (WindowGroupLimit), so a hot key never travels whole."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") <= 1).drop("_rn")


def top_n_per_key(df: DataFrame, key: str, n: int, order: list[Column], row_id: str,
                  buckets: int = 64) -> DataFrame:
    """The first n rows of every key, ranked in two steps.

    Each key is first cut to n rows in every one of `buckets` parts, so the
    final rank of a key sorts at most n * buckets rows however hot it is.
    """
    inner = W.partitionBy(key, "_part").orderBy(*order)
    outer = W.partitionBy(key).orderBy(*order)
    return (
        df.withColumn("_part", F.pmod(F.xxhash64(row_id), F.lit(buckets)))
        .withColumn("_rn", F.row_number().over(inner)).where(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(outer)).where(F.col("_rn") <= n)
        .drop("_part", "_rn")
    )

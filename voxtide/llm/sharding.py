"""Shards cut from a Hilbert curve over quantised metadata."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from voxtide.session import cut_lineage

PARTS = 1024  # parts of a curve cell, so that one cell may hold a third of all rows


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of the point with these coordinates (long
    columns, 0 to 2**bits - 1), by Skilling's transpose method."""
    n = len(axes)

    def let(state: Column, change) -> Column:
        """A step on the coordinates; transform() binds the state once."""
        return F.transform(F.array(state), change)[0]

    def put(s: Column, values: dict[int, Column]) -> Column:
        return F.struct(*[values.get(i, s[f"x{i}"]).alias(f"x{i}") for i in range(n)])

    def turn(q: int, i: int):
        """Invert the low bits of the first coordinate, or exchange them with those of coordinate i."""
        def change(s: Column) -> Column:
            has = s[f"x{i}"].bitwiseAND(F.lit(q)) != 0
            t = s["x0"].bitwiseXOR(s[f"x{i}"]).bitwiseAND(F.lit(q - 1))
            flipped = s["x0"].bitwiseXOR(F.lit(q - 1))
            if i == 0:
                return put(s, {0: F.when(has, flipped).otherwise(s["x0"])})
            return put(s, {0: F.when(has, flipped).otherwise(s["x0"].bitwiseXOR(t)), i: F.when(has, s[f"x{i}"]).otherwise(s[f"x{i}"].bitwiseXOR(t))})
        return change

    state = F.struct(*[a.cast("long").alias(f"x{i}") for i, a in enumerate(axes)])
    for q in [1 << b for b in range(bits - 1, 0, -1)]:
        for i in range(n):
            state = let(state, turn(q, i))

    def gray(s: Column) -> Column:
        out = [s["x0"]]
        for i in range(1, n):
            out.append(s[f"x{i}"].bitwiseXOR(out[-1]))
        t = F.lit(0).cast("long")
        for q in [1 << b for b in range(bits - 1, 0, -1)]:
            t = F.when(out[-1].bitwiseAND(F.lit(q)) != 0, t.bitwiseXOR(F.lit(q - 1))).otherwise(t)
        return F.struct(*[v.alias(f"x{i}") for i, v in enumerate(out)], t.alias("t"))

    def weave(s: Column) -> Column:
        x = [s[f"x{i}"].bitwiseXOR(s["t"]) for i in range(n)]
        picked = [F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1)), b * n + n - 1 - i) for b in range(bits) for i, v in enumerate(x)]
        return functools.reduce(lambda a, b: a.bitwiseOR(b), picked)

    return let(let(state, gray), weave)


def _ordered(docs: DataFrame, name: str) -> Column:
    """A metadata column as a number or a string that keeps its order; a null number is -1."""
    kind = docs.schema[name].dataType
    if isinstance(kind, T.NumericType):
        value = F.col(name).cast("double")
    elif isinstance(kind, (T.DateType, T.TimestampType)):
        value = F.unix_timestamp(F.col(name).cast("timestamp")).cast("double")
    else:
        return F.col(name).cast("string")
    return F.coalesce(F.when(F.isnan(value), None).otherwise(value), F.lit(-1.0))


def string_cuts(rows: DataFrame, names: list[str], levels: int) -> dict[str, list[tuple[str | None, int]]]:
    """For string columns, the values at the quantiles k / levels of the rows with the
    number of quantiles each stands for, in order; whole values, nulls first.

    Rows are counted by value, the values are sorted by many tasks, and ranks are
    prefix sums over the tasks and within each. At most levels - 1 values a column
    reach the driver."""
    if not names:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), F.col(n).alias("value")) for n in names]))
    counts = rows.select(pairs.alias("r")).groupBy("r.dim", "r.value").agg(F.count("*").alias("n"))
    ordered = cut_lineage(counts.orderBy("dim", F.asc_nulls_first("value")).withColumn("task", F.spark_partition_id()))
    tasks = ordered.groupBy("dim", "task").agg(F.sum("n").alias("m"))
    before = F.sum("m").over(W.partitionBy("dim").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    tasks = tasks.select("dim", "task", F.coalesce(before, F.lit(0)).alias("before"), F.sum("m").over(W.partitionBy("dim")).alias("total"))
    inner = F.sum("n").over(W.partitionBy("dim", "task").orderBy(F.asc_nulls_first("value")).rowsBetween(W.unboundedPreceding, 0))
    ranked = ordered.withColumn("inner", inner).join(tasks, ["dim", "task"]).withColumn("upto", F.col("before") + F.col("inner"))

    def reached(rank: Column) -> Column:
        return F.least(F.floor(rank * levels / F.col("total")), F.lit(levels - 1))

    found = ranked.withColumn("k", (reached(F.col("upto")) - reached(F.col("upto") - F.col("n"))).cast("int")).where("k > 0")
    out: dict = {n: [] for n in names}
    for r in found.select("dim", "upto", "value", "k").orderBy("dim", "upto").collect():
        out[r.dim].append((r.value, r.k))
    return out


def _string_level(name: str, cuts: list[tuple[str | None, int]]) -> Column:
    """Number of the quantiles below a string; null has none."""
    above = [F.when(F.col(name).isNotNull() if c is None else F.col(name) > F.lit(c), k).otherwise(0) for c, k in cuts]
    return functools.reduce(lambda a, b: a + b, above, F.lit(0))


def hilbert_shards(docs: DataFrame, dims: tuple[str, ...] = ("lang", "source", "n_chars"), shards: int = 16, bits: int = 4,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard, so that a shard is a run of the Hilbert curve and a file
    of it spans little of each metadata column.

    Each of `dims` is quantised to 2**bits levels at its quantiles: numbers and times
    by a bounded sketch over all rows, strings by exact counts of whole values. Rows are ordered by their cell's curve index, within a
    cell by a hash of the row, and the order is cut into `shards` runs whose row
    counts differ by one at most (law `rows`).

    No global sort: rows are counted by cell (2**(bits * dims) at most) and by
    PARTS parts of each cell, ranks within a part come from a window, and offsets
    are prefix sums over the counts. So a cell that holds a third of all rows is
    still many groups, and only numbers travel: the text gives its size and
    checksum where it is read.

    Null metadata is below all values; a null text has size 1 and the checksum of
    an empty one; repeated rows and ids are rows of their own. An empty table gives
    no row. Only id, text and dims are read.

    Returns id, size (UTF-8 bytes + 1), text_crc32, curve, shard, slot (place in
    the shard).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("th"), *[_ordered(docs, d).alias(f"d{i}") for i, d in enumerate(dims)]))
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    kinds = dict(rows.dtypes)
    names = [f"d{i}" for i in range(len(dims))]
    numbers = [n for n in names if kinds[n] == "double"]
    words = string_cuts(rows, [n for n in names if n not in numbers], 1 << bits)
    cuts = rows.agg(*[F.percentile_approx(n, steps, 10_000).alias(n) for n in numbers]).first() if numbers else {}

    def level(n: str) -> Column:
        if n in words:
            return _string_level(n, words[n])
        return functools.reduce(lambda a, b: a + b, [(F.col(n) > c).cast("int") for c in cuts[n] or []], F.lit(0))

    levels = [level(n) for n in names]
    placed = rows.select("id", "size", "text_crc32", hilbert_index(levels, bits).alias("curve"),
                         F.xxhash64("id", "th").alias("h")).withColumn("part", F.pmod("h", F.lit(PARTS)))
    counts = cut_lineage(placed.groupBy("curve", "part").agg(F.count("*").alias("n")))
    cells = counts.groupBy("curve").agg(F.sum("n").alias("m"))
    ahead = cells.withColumn("before", F.coalesce(F.sum("m").over(W.orderBy("curve").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(ahead.select("curve", "before"), "curve").select(
        F.col("curve").alias("oc"), F.col("part").alias("op"), (F.col("before") + F.col("inner")).alias("offset"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rank = F.row_number().over(W.partitionBy("curve", "part").orderBy("h", "id")) - 1
    ranked = placed.withColumn("rank", rank).join(offsets, (F.col("curve") == F.col("oc")) & (F.col("part") == F.col("op"))).withColumn("at", F.col("offset") + F.col("rank"))
    small, more = divmod(total, shards)
    edge = more * (small + 1)  # the first `more` shards hold one row more
    big = F.lit(small + 1)
    shard = F.when(F.col("at") < edge, F.floor(F.col("at") / big)).otherwise(more + F.floor((F.col("at") - edge) / F.lit(max(small, 1)))).cast("int")
    first = F.when(F.col("shard") < more, F.col("shard") * big).otherwise(edge + (F.col("shard") - more) * small)
    return (ranked.withColumn("shard", shard).withColumn("slot", (F.col("at") - first).cast("long"))
            .select(F.col("id").alias(id_col), "size", "text_crc32", "curve", "shard", "slot"))


def write_shards(docs: DataFrame, path: str, dims: tuple[str, ...] = ("lang", "source", "n_chars"), shards: int = 16, bits: int = 4,
                 rows_per_file: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs below path, one folder per shard and files that follow the curve,
    so that readers skip files by the minima and maxima of each dimension. Rows of
    docs meet their place by id and text hash; rows equal in both share it."""
    place = hilbert_shards(docs.withColumn("_th", F.xxhash64(F.col(text_col).cast("string"))), dims, shards, bits, id_col, text_col)
    place = place.groupBy(F.col(id_col).alias("_id"), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc")).agg(F.min("shard").alias("shard"), F.min("slot").alias("_slot"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    on = docs[id_col].eqNullSafe(F.col("_id")) & ((F.octet_length(text) + 1) == F.col("_size")) & (F.crc32(text.cast("binary")) == F.col("_crc"))
    rows = docs.join(place, on).withColumn("_file", F.floor(F.col("_slot") / rows_per_file))
    (rows.repartition(F.col("shard"), F.col("_file")).sortWithinPartitions("shard", "_slot").drop("_id", "_size", "_crc", "_slot", "_file")
     .write.partitionBy("shard").parquet(path))

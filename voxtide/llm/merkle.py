"""Merkle manifest of a table: a digest for every row, group and for the whole, and
for each row the proof that leads from it to the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from voxtide.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """A value with its length before it, so that no two rows read alike; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def row_digest(values: list[Column]) -> Column:
    return digest(*[field(v) for v in values])


def group_key(column: Column) -> Column:
    """A key that is never null and sorts bytewise, null before every value."""
    return F.coalesce(F.concat(F.lit("."), column.cast("string")), F.lit(""))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with their place `lo` in their group `g`, `hi` = lo + 1, and the group's size `n`.

    Rows are dealt over all tasks by (g, order), so a group of any size is sorted in
    many; each task numbers its own, and prefix sums over (group, task) - no more rows
    than there are groups and tasks - say where it begins. Rows equal in all of
    `order` are told apart by a number, so they spread too.
    """
    keys = ["g", *order, "_salt"]
    dealt = cut_lineage(rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
                        .withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)).drop("_salt"))
    tasks = dealt.groupBy("g", "_task").agg(F.count(F.lit(1)).alias("k"), F.min("_at").alias("first"))
    own = W.partitionBy("g")
    tasks = cut_lineage(tasks.select("g", "_task", "first", F.sum("k").over(own).alias("n"),
                                     (F.sum("k").over(own.orderBy("_task").rowsBetween(W.unboundedPreceding, 0)) - F.col("k")).alias("before")))
    lo = F.col("before") + F.col("_at") - F.col("first")
    return dealt.join(tasks, ["g", "_task"]).withColumns({"lo": lo, "hi": lo + 1}).drop("_at", "_task", "first", "before")


def grow(leaves: DataFrame, arity: int = 3) -> list[DataFrame]:
    """Nodes above the leaves by level, from level 1: group g, covered leaf ranks
    [lo, hi), the group's number of leaves n, digest, and the intervals and digests
    of the children.

    A node's children are the nodes below whose interval lies in its own, found by
    bucketing the ranks by the level's width: at most `arity` rows meet in a group,
    whatever the size of the table. A level holds 1/arity of the one below and is
    written, so each is computed once. A group stops at its single node.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes, width = [], leaves, 1
    while width < most:
        width *= arity
        kids = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest")))
        met = nodes.where(F.col("n") > width // arity).groupBy("g", F.expr(f"lo div {width}").alias("bucket")).agg(kids.alias("kids"), F.min("n").alias("n"))
        nodes = cut_lineage(met.select(
            "g", "bucket", F.col("kids")[0]["lo"].alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"), "n",
            digest(F.array_join(F.col("kids")["digest"], "")).alias("digest"), "kids"))
        levels.append(nodes)
    return levels


def subroots(leaves: DataFrame, levels: list[DataFrame], arity: int = 3) -> DataFrame:
    """g and digest of the node that covers a whole group."""
    out, width = leaves.where("n = 1").select("g", "digest"), 1
    for nodes in levels:
        width *= arity
        out = out.unionByName(nodes.where((F.col("n") <= width) & (F.col("n") > width // arity)).select("g", "digest"))
    return out


def descend(leaves: DataFrame, levels: list[DataFrame], above: DataFrame, carry: list[str], arity: int = 3) -> DataFrame:
    """leaves with the `path` of sibling digests from the leaf up, and columns `carry`
    of its group.

    above: one row per group: g, carry, and the path from the group's own node to the
    root. Level by level from the top, a node meets the parent whose interval contains
    its own (bucketed by the parent's width); the parent's children less the node's
    interval are its siblings, and the parent's path continues its own.
    """
    width = arity ** len(levels)
    upper = None
    for level in range(len(levels), -1, -1):
        nodes = levels[level - 1].drop("bucket") if level else leaves
        # groups whose single node is on this level enter here
        whole = F.col("n") == 1 if not level else (F.col("n") <= width) & (F.col("n") > width // arity)
        entering = nodes.where(whole).join(above, "g")
        if upper is None:
            found = entering
        else:
            parents = upper.select(F.col("g").alias("pg"), F.expr(f"lo div {width * arity}").alias("pb"), F.col("lo").alias("plo"), F.col("hi").alias("phi"),
                                  F.col("kids").alias("pk"), "path", *carry)
            inside = (F.col("g") == F.col("pg")) & (F.expr(f"lo div {width * arity}") == F.col("pb")) & (F.col("plo") <= F.col("lo")) & (F.col("hi") <= F.col("phi"))
            met = nodes.where(F.col("n") > width).join(parents, inside)
            side = lambda keep: F.array_join(F.filter("pk", keep)["digest"], "")
            step = F.struct(side(lambda k: k["hi"] <= F.col("lo")).alias("left"), side(lambda k: k["lo"] >= F.col("hi")).alias("right"))
            found = met.withColumn("path", F.concat(F.array(step), "path")).select(entering.columns).unionByName(entering)
        upper, width = found, width // arity
    return upper


def fold(leaf: Column, path: Column | str) -> Column:
    """The root that a leaf digest and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, s: digest(s["left"], acc, s["right"]))


def proof_digest(path: str) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def merkle_proofs(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_col: str = "source", id_col: str = "doc_id",
                  arity: int = 3, altered: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id, leaf, subroot, root and path, the sibling digests
    (left and right of the node) on every level from the leaf to the root.

    A leaf is the SHA-256 of the fields, each with its length. Per group the leaves
    ascend by id and every `arity` consecutive nodes become one until one is left,
    the subroot; the subroots in the order of their groups give the root likewise.
    With `altered` (new expressions for some fields) `altered_leaf` is the digest of
    the row as altered, or null where nothing changed; `fold` tells what root it gives.

    One pass over the texts; from then on digests and intervals travel. Each level of
    the tree is a table in the shared folder, 1/arity of the one below.

    A null group is a group of its own, before all others. Null ids come first, rows of
    one id by their digest; equal rows are interchangeable. A null field has its own
    mark, unlike an empty one. An empty table gives no row. Columns of other names are
    not read, whatever they are called.
    """
    kind = docs.schema[id_col].dataType
    own = row_digest([docs[f] for f in fields])
    other = row_digest([(altered or {}).get(f, docs[f]) for f in fields]) if altered else F.lit(None).cast("string")
    rows = cut_lineage(docs.select(group_key(docs[group_col]).alias("g"), docs[id_col].cast(kind).alias("id"), own.alias("digest"), F.nullif(other, own).alias("altered")))
    leaves = cut_lineage(ranked(rows, ["id", "digest", "altered"]))
    levels = grow(leaves, arity)
    groups = cut_lineage(subroots(leaves, levels, arity))
    tops = cut_lineage(ranked(groups.select(F.lit("").alias("g"), F.col("g").alias("group"), "digest"), ["group", "digest"]))
    top_levels = grow(tops, arity)
    root = subroots(tops, top_levels, arity).select("g", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    above = descend(tops, top_levels, root, ["root"], arity).select(F.col("group").alias("g"), F.col("digest").alias("subroot"), "root", "path")
    out = descend(leaves, levels, cut_lineage(above), ["subroot", "root"], arity)
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "subroot", "root", "path", F.col("altered").alias("altered_leaf"))

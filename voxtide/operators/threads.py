"""Reply threads judged by all rules, with one duplicate memory for posts and replies.

The order of judgement is that of a collector that first takes the posts in their
order and then walks each accepted post's thread: a reply before the replies to it,
and those before the next reply to the same post. A rejected reply takes its subtree
along, so what stands below it is never judged and enters no memory.

A row's path, the order numbers from its post down to itself, says all of that: paths
compared as arrays are in the order of the walk, and a path's own beginning names its
ancestors. Rules on one row are settled where the row lies, and level by level only
rows that pass them are reached. What is left is the duplicate rule, whose verdicts
depend on verdicts before them. They are found in rounds over the contested rows alone
(those whose fuzzy hash stands for several texts): given who is rejected, the first
living row of every hash sets the text that the others must equal, which says anew who
is rejected. The first k verdicts of the walk are right after k rounds, whatever the
others are, so the rounds end at the one right answer; chains of verdicts that depend
on one another are short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.operators.language import Detector
from voxtide.operators.rules import judge
from voxtide.operators.skew import attach_lookup, attach_stats
from voxtide.session import cut_lineage

MEMORY = ["_hash", "_d1", "_d2"]


def thread_paths(nodes: DataFrame, depth: int, id_col: str, parent_col: str, order: str) -> DataFrame:
    """nodes that a walk of at most `depth` steps from the roots (rows without a parent)
    reaches, with `path`. One join a level, on numbers; each level is written once."""
    roots = nodes.where(F.col(parent_col).isNull()).withColumn("path", F.array(order))
    rest = nodes.where(F.col(parent_col).isNotNull())
    levels = [cut_lineage(roots)]
    for _ in range(depth):
        above = levels[-1].select(F.col(id_col).alias(parent_col), "path")
        found = attach_lookup(rest, above, parent_col, ["path"]).where(F.col("path").isNotNull())
        level = cut_lineage(found.select(*nodes.columns, F.concat("path", F.array(order)).alias("path")))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def below(rows: DataFrame, gone: DataFrame, order: str, itself: bool) -> DataFrame:
    """order of the rows with an ancestor in `gone` (or that are in it themselves)."""
    steps = F.col("path") if itself else F.slice("path", F.lit(1), F.size("path") - 1)
    spread = rows.select(F.col(order).alias("_row"), F.explode(steps).alias("_step"))
    hit = attach_lookup(spread, gone.select(F.col(order).alias("_step"), F.lit(True).alias("_gone")), "_step", ["_gone"])
    return hit.where("_gone").select(F.col("_row").alias(order)).distinct()


def duplicate_verdicts(nodes: DataFrame, order: str) -> DataFrame:
    """order of the rows that the duplicate rule rejects, each in its turn of the walk."""
    several = nodes.groupBy("_hash").agg(F.min("_d1").alias("_a"), F.max("_d1").alias("_b"), F.min("_d2").alias("_c"), F.max("_d2").alias("_d"), F.count(F.lit(1)).alias("_n"))
    several = several.where("_a <> _b or _c <> _d").withColumn("_several", F.lit(True))
    contested = cut_lineage(attach_stats(nodes, several, ["_hash"], ["_several"], "_n", F.col(order)).where("_several").select(order, "path", *MEMORY))
    gone, mark = None, None
    turn = F.struct(F.size("path") > 1, F.col("path"))
    while True:
        living = contested if gone is None else contested.join(below(contested, gone, order, False), order, "left_anti")
        firsts = living.groupBy("_hash").agg(F.min_by("_d1", turn).alias("_f1"), F.min_by("_d2", turn).alias("_f2"), F.count(F.lit(1)).alias("_n"))
        judged = attach_stats(living, cut_lineage(firsts), ["_hash"], ["_f1", "_f2"], "_n", F.col(order))
        gone = cut_lineage(judged.where((F.col("_f1") != F.col("_d1")) | (F.col("_f2") != F.col("_d2"))).select(order))
        found = gone.agg(F.count(F.lit(1)), F.expr(f"bit_xor(xxhash64({order}))"), F.expr(f"bit_xor(xxhash64({order}, 1))")).first()
        if found == mark:
            return gone
        mark = found


def judged_threads(edges: DataFrame, detector: Detector, typed: Column, depth: int = 6, id_col: str = "post_id", parent_col: str = "parent_post_id",
                   order: str = "ingest_seq", text: str = "text", lang: str = "lang", phrases: list[str] | None = None) -> DataFrame:
    """Replies accepted by all rules, with their `depth` below an accepted post.

    `typed` says which rows are readable replies; `id_col` and `order` must be unique,
    and the replies to one row come in the order of `order`. Posts (rows without a
    parent) are judged too: below a rejected one nothing is fetched, and an accepted
    one is remembered by the duplicate rule before any reply.

    Texts are judged where they lie and travel once, to meet the accepted ids.
    """
    judged = judge(edges.where(F.col(parent_col).isNull() | typed), detector, text, lang, phrases=phrases)
    passed = cut_lineage(judged.where(F.col("_row_reason").isNull()).select(id_col, parent_col, order, *MEMORY))
    nodes = cut_lineage(thread_paths(passed, depth, id_col, parent_col, order))
    gone = duplicate_verdicts(nodes, order)
    kept = nodes.where(F.size("path") > 1).join(below(nodes, gone, order, True), order, "left_anti")
    return edges.join(kept.select(order, (F.size("path") - 1).alias("depth")), order)

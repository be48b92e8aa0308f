"""Agreement between annotators."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.functions.vocab import KAPPA_BANDS


def merge_annotators(tables: dict[str, DataFrame], tasks: list[str], key: str = "post_id") -> DataFrame:
    """Rows that every annotator labelled, label columns suffixed by annotator."""
    renamed = [t.select(key, *[F.col(c).alias(f"{c}_{s}") for c in tasks]) for s, t in tables.items()]
    return reduce(lambda a, b: a.join(b, key), renamed)


def kappa_band(kappa: Column) -> Column:
    out = F.lit(None).cast("string")
    for limit, name in reversed(KAPPA_BANDS):
        out = F.when(kappa <= limit, name).otherwise(out)
    return F.when(kappa.isNotNull(), out)


def fleiss_kappa(merged: DataFrame, tasks: list[str], raters: list[str]) -> DataFrame:
    """task, kappa, n, band over rows without a blank.

    Agreeing rater pairs are counted inside the row and categories by one
    aggregate with map-side combine; nothing per post is shuffled.
    """
    pairs = list(combinations(raters, 2))
    per_task = []
    for task in tasks:
        cols = [F.col(f"{task}_{r}") for r in raters]
        complete = reduce(lambda a, b: a & b, [c.isNotNull() for c in cols])
        agree = sum([(F.col(f"{task}_{a}") == F.col(f"{task}_{b}")).cast("int") for a, b in pairs], F.lit(0))
        per_task.append(F.when(complete, F.struct(F.lit(task).alias("task"), F.array(*cols).alias("votes"), agree.alias("agree"))))
    rows = merged.select(F.explode(F.array(*per_task)).alias("t")).where("t is not null").select("t.*")
    # one record per vote; the first vote of a row carries its agreement
    votes = rows.select("task", F.posexplode("votes").alias("i", "category"), "agree")
    by_cat = votes.groupBy("task", "category").agg(
        F.count(F.lit(1)).alias("votes"),
        F.sum(F.when(F.col("i") == 0, F.col("agree")).otherwise(0)).alias("agree"),
        F.count_if(F.col("i") == 0).alias("rows"),
    )
    r = len(raters)
    sums = by_cat.groupBy("task").agg(
        F.sum("rows").alias("n"), F.sum("agree").alias("agree"), F.sum(F.col("votes") * F.col("votes")).alias("sq"))
    observed = F.col("agree") / (F.col("n") * len(pairs))
    chance = F.col("sq") / (F.col("n") * r * F.col("n") * r)
    kappa = F.when(chance != 1, (observed - chance) / (1 - chance))
    return sums.select("task", kappa.alias("kappa"), "n").withColumn("band", kappa_band(F.col("kappa")))

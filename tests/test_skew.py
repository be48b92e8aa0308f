"""The skew helpers give the plain join's and the plain rank's result on hot keys."""

from pyspark.sql import functions as F

from voxtide.operators import skew


def hot_rows(spark, n=3000):
    # a third of all rows share one key, some rows have none
    return spark.range(n).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 1500)).alias("key"))


def test_attach_stats_is_a_left_join(spark):
    rows = hot_rows(spark)
    stats = rows.where("key is not null").groupBy("key").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    got = skew.attach_stats(rows, stats, ["key"], ["first"], "n", F.col("seq"))
    want = rows.join(stats.drop("n"), "key", "left").select("seq", "key", "first")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_hot_rows_are_scattered_in_the_shuffled_join(spark):
    rows = hot_rows(spark)
    stats = rows.where("key is not null").groupBy("key").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    plan = skew.attach_stats(rows, stats, ["key"], ["first"], "n", F.col("seq"))._jdf.queryExecution().optimizedPlan().toString()
    # the spread number must have stayed a join key
    assert "_spread" in plan and "_c_spread" in plan


def test_attach_lookup_is_a_left_join(spark):
    rows = hot_rows(spark)
    lookup = spark.createDataFrame([("hot", "a"), ("k7", "b"), ("zz", "c")], "key string, value string")
    got = skew.attach_lookup(rows, lookup, "key", ["value"])
    want = rows.join(lookup, "key", "left").select("seq", "key", "value")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_top_n_and_first_per_key(spark):
    rows = hot_rows(spark)
    got = skew.top_n_per_key(rows.where("key is not null"), "key", 5, [F.col("seq")], "seq")
    hot = sorted(r["seq"] for r in got.where("key = 'hot'").collect())
    assert hot == [0, 3, 6, 9, 12]
    first = skew.first_per_key(rows.where("key is not null"), ["key"], [F.col("seq").desc()])
    assert first.where("key = 'hot'").first()["seq"] == 2997
    assert first.count() == rows.where("key is not null").select("key").distinct().count()

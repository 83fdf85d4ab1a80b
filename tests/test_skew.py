"""One key with most of the rows: joins and row numbers must be spread and still be right."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.helpers import rows
from tidemark.operators import ordering
from tidemark.operators.ordering import ranked
from tidemark.operators.skew import heavy_keys, lookup_join, skew_join


def hot(spark, n=9000):
    """Two thirds of the rows have key 0."""
    return spark.range(n).select(F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))


def test_skew_join_equals_plain_join(spark):
    left = hot(spark)
    right = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(repr, rows(left.join(right, ["k"], how))))
        got = sorted(map(repr, rows(skew_join(left, right, ["k"], how, min_rows=500))))
        assert got == want, how


def test_skew_join_many_to_many(spark):
    left = hot(spark, 900)
    right = spark.range(40).select((F.col("id") % 4).alias("k"), F.col("id").alias("w"))
    got = skew_join(left, right, ["k"], min_rows=100)
    assert got.count() == left.join(right, ["k"]).count()
    assert got.distinct().count() == got.count()


def test_heavy_rows_are_spread(spark):
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in plain.items():
        spark.conf.set(name, value)
    try:
        right = spark.range(50).withColumnRenamed("id", "k")
        joined = skew_join(hot(spark), right, ["k"], min_rows=500)
        sizes = [r["count"] for r in joined.filter("k = 0").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name in plain:
            spark.conf.unset(name)
    assert sum(sizes) == hot(spark).filter("k = 0").count()
    assert max(sizes) < sum(sizes) / 2


def test_no_key_above_the_threshold_is_missed(spark):
    counts = hot(spark).groupBy("k").count()
    share = max(500, 9000 / int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert rows(heavy_keys(counts, ["k"], "count", 500)) == [(0, -int(-6000 // share))]
    spark.conf.set("spark.sql.shuffle.partitions", "10000")
    try:
        many = spark.range(5000).select(F.col("id").alias("k"), F.lit(9).alias("n"))
        cut = heavy_keys(many, ["k"], "n", 1).collect()
        assert len(cut) == 5000 and all(r._salts == 2 for r in cut)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_lookup_join_both_ways(spark):
    left, table = hot(spark, 300), spark.range(50).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    small, large = lookup_join(left, table, ["k"]), lookup_join(left, table, ["k"], small_bytes=10)
    assert sorted(rows(small)) == sorted(rows(large))


def test_ranks_within_a_hot_key(spark):
    got = ranked(hot(spark), [F.desc("v")], keys=["k"])
    want = hot(spark).withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"))))
    assert sorted(rows(got)) == sorted(rows(want))


def test_ranks_of_equal_rows_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1)] * 5 + [(7, 2)] * 4, "k int, v int")
    assert sorted(r.rank for r in ranked(df, ["v"], keys=["k"]).collect()) == [1, 1, 2, 2, 3, 3, 4, 4, 5]
    assert sorted(r.rank for r in ranked(df, ["v"]).collect()) == list(range(1, 10))


def test_hot_key_is_cut_into_chunks(spark, monkeypatch):
    kept = []
    materialise = ordering.materialise
    monkeypatch.setattr(ordering, "materialise", lambda df, label: kept.append(materialise(df, label)) or kept[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the test table is too small to be cut
    try:
        ranked(hot(spark), ["v"], keys=["k"]).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    chunks = kept[0].filter("k = 0").groupBy("_chunk").count().collect()
    assert len(chunks) > 3 and max(r["count"] for r in chunks) < 3000

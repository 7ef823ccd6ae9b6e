"""Positions at a size where range partitions are really sampled."""

from corpusloom.operators import mix
from pyspark.sql import Window
from pyspark.sql import functions as F

ROWS = 2_000_000


def test_positions_are_distinct_with_a_payload(spark):
    df = spark.range(ROWS).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    got = mix.numbered(df, mix.random_key(3, "k"), "k").agg(F.count("*"), F.count_distinct("row_idx"), F.min("row_idx"), F.max("row_idx")).first()
    assert tuple(got) == (ROWS, ROWS, 0, ROWS - 1)


def test_hot_key_and_nulls_keep_the_order(spark):
    df = spark.range(200_000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("k"))
    out = mix.numbered(df, "k", hot=True)
    assert out.agg(F.count_distinct("row_idx")).first()[0] == 200_000
    before = F.lag(F.struct("k")).over(Window.orderBy("row_idx"))
    assert out.select(before.alias("p"), F.struct("k").alias("k")).filter("p > k").count() == 0


def test_sample_and_split_take_exact_numbers(spark):
    df = spark.range(50_000).select(F.col("id").alias("row_idx"))
    assert mix.sampled(df, 1234, 5).select("row_idx").distinct().count() == 1234
    assert mix.split(df, 0.1, 5).filter("split = 'validation'").count() == 5000
    assert mix.numbered(df.limit(0), "row_idx").count() == 0

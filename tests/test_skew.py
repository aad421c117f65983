from collections import Counter

import pytest
from pyspark.sql import functions as F

from runledger.operators.skew import hot_keys, key_hash, spread_join


def sides(spark):
    left = spark.range(0, 3000, numPartitions=7).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, F.lit(None)).otherwise((F.col("id") % 50).cast("string")).alias("k"),
        F.col("id").alias("l"),
    )
    right = spark.range(0, 120, numPartitions=4).select(
        F.when(F.col("id") % 4 == 0, "hot").when(F.col("id") % 4 == 1, F.lit(None)).otherwise((F.col("id") % 60).cast("string")).alias("k"),
        F.col("id").alias("r"),
    )
    return left, right


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_only_heavy_keys_are_reported(spark):
    left, _ = sides(spark)
    hot = hot_keys(left, ["k"], partitions=8)
    assert list(hot) == [spark.range(1).select(F.lit("hot").alias("k")).select(key_hash(["k"])).first()[0]]
    assert list(hot.values())[0] >= 5


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
@pytest.mark.parametrize("hot_left,hot_right", [({}, {}), (None, {}), (None, None)])
def test_same_rows_as_a_plain_join(spark, how, hot_left, hot_right):
    left, right = sides(spark)
    if how == "left":
        right = right.dropDuplicates(["k"])
    if hot_left is None:
        hot_left = hot_keys(left, ["k"], partitions=40)
    if hot_right is None:
        hot_right = hot_keys(right, ["k"], partitions=40)
    columns = ["k", "l"] if how == "left_anti" else ["k", "l", "r"]
    got = spread_join(left, right, ["k"], how, F.col("l") > F.col("r"), hot_left, hot_right)
    renamed = right.withColumnRenamed("k", "rk")
    want = left.join(renamed, (F.col("k") == F.col("rk")) & (F.col("l") > F.col("r")), how)
    assert counted(got, *columns) == counted(want, *columns)


def test_a_hot_key_is_spread_over_tasks(spark):
    left, right = sides(spark)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_join(left, right, ["k"], "inner", hot_left=hot_keys(left, ["k"], partitions=8))
        tasks = joined.filter("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
        nulls = spread_join(left, right.select("k").distinct(), ["k"], "left_anti").filter("k IS NULL")
        assert tasks > 1
        assert nulls.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)

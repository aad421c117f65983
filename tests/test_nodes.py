import pytest
from pyspark.sql import functions as F

from runledger.functions.nodes import RADIX, covering_nodes, levels_for, nodes_above


@pytest.mark.parametrize("longest", [0, 31, 32, 300, 1_023, 5_000])
def test_every_bucket_meets_its_interval_once(spark, longest):
    """The nodes above a bucket and the nodes of an interval share one exactly where the bucket lies inside."""
    levels = levels_for(longest)
    rows = [(a, a + n) for a in (-40, -16, 0, 7, 16, 255, 257, 1_000) for n in {0, 1, longest // 2, max(longest - 1, 0), longest}]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", covering_nodes(F.col("a"), F.col("b"), levels).alias("nodes")).collect()
    above = {r.x: set(r.up) for r in spark.range(-100, 6_200).select(F.col("id").alias("x"), nodes_above(F.col("id"), levels).alias("up")).collect()}
    for r in got:
        assert len(r.nodes) <= 2 * (RADIX - 1) * levels
        for x in {r.a - 17, r.a - 1, r.a, r.a + 1, (r.a + r.b) // 2, r.b, r.b + 1, r.b + 16}:
            assert sum(n in above[x] for n in r.nodes) == (r.a <= x <= r.b), (r, x)

"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.storage import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the smallest of u and its neighbours as ``m``."""
    least = edges.groupBy(F.col("u").alias("of")).agg(F.min("v").alias("m"))
    return edges.join(least, F.col("u") == F.col("of")).select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _smallest(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. Edges run from larger to smaller nodes."""
    tied = _smallest(edges)
    return tied.select("u", F.col("m").alias("v")).unionByName(tied.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u > v")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge to another; ``component`` is the smallest node reachable.

    ``edges`` has two columns of the same orderable type. Alternating star operations, each result written to
    the shared folder; the number of rounds grows with the logarithm of the longest chain. Edges with a NULL and loops
    are ignored.
    """
    a, b = (F.col(c) for c in edges.columns)
    last = stored(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before = None
    while True:
        now = last.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if now == before or not now.n:
            return last.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                last.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        last = stored(_small_star(_large_star(last)).distinct(), "edges")

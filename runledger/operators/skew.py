"""Equi-joins that stay balanced when one key holds a large share of the rows.

The join keys are sketched before the join is built (frequent items, bounded size). A key whose share
exceeds a fair partition is spread over several reducers: each of its rows on one side goes to one part,
the matching rows of the other side go to all parts. Without such a key the join is a plain one and
Spark chooses the strategy.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from math import ceil
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

# Entries kept of a sketch: as many keys as can exceed a fair partition, within these bounds. Twice the upper one
# bounds the broadcast list of hot keys.
FEWEST_HOT_KEYS, MOST_HOT_KEYS = 256, 5_000
_HOT = StructType([StructField("_key", LongType()), StructField("_lefts", IntegerType()), StructField("_rights", IntegerType())])


def key_hash(on: list[str]) -> Column:
    """One number per key, NULL when a part of the key is NULL and it cannot match."""
    any_null = reduce(or_, (F.col(name).isNull() for name in on))
    return F.when(~any_null, F.xxhash64(*on))


def sketch(column: str, alias: str, partitions: int) -> Column:
    """Aggregate: the most frequent values of a hashed key, as many as can exceed one of ``partitions``."""
    kept = min(MOST_HOT_KEYS, max(FEWEST_HOT_KEYS, partitions))
    return F.expr(f"approx_top_k({column}, {kept}) FILTER (WHERE {column} IS NOT NULL)").alias(alias)


def parts_of(top: Iterable[Row] | None, rows: int, partitions: int) -> dict[int, int]:
    """Number of parts for each key that exceeds a fair share of the rows."""
    parts = {item["item"]: ceil(2 * partitions * item["count"] / rows) for item in (top or []) if rows}
    return {key: n for key, n in parts.items() if n > 2}


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, on: list[str], partitions: int | None = None) -> dict[int, int]:
    """Hot keys of a table with the parts to split each into; one pass over the key columns."""
    partitions = partitions or shuffle_partitions(df)
    row = df.select(key_hash(on).alias("_key")).agg(sketch("_key", "top", partitions), F.count("*").alias("n")).first()
    return parts_of(row.top, row.n, partitions)


def _spread(df: DataFrame, on: list[str], hot: DataFrame | None, own: str, other: str, spread_nulls: bool) -> DataFrame:
    """Adds ``own``, the part a row belongs to, and repeats the row for every part of the other side."""
    key = key_hash(on)
    # A row's part follows from its other columns: the same at every attempt, and however the rows are laid out.
    others = [name for name, kind in df.dtypes if name not in on and "map<" not in kind] or on
    spot = F.pmod(F.xxhash64(*others), F.lit(2**31 - 1))
    if hot is None:
        # Zero for every key, but not a constant that the optimizer would drop from the partitioning.
        part = F.coalesce(key % 1, F.lit(0)).cast("int")
        spread = df.withColumn("_spot", spot).withColumn(other, part)
    else:
        spread = (
            df.withColumn("_spot", spot)
            .withColumn("_key", key)
            .join(F.broadcast(hot), "_key", "left")
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"_{other}") - 1, F.lit(0)))))
        )
        part = F.coalesce(F.col("_spot") % F.col(f"_{own}"), F.lit(0)).cast("int")
    if spread_nulls:
        part = F.when(reduce(or_, (F.col(name).isNull() for name in on)), F.col("_spot").cast("int")).otherwise(part)
    return spread.withColumn(own, part).drop("_spot", "_key", "_lefts", "_rights")


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    condition: Column | None = None,
    hot_left: dict[int, int] | None = None,
    hot_right: dict[int, int] | None = None,
    multiplies: bool = False,
) -> DataFrame:
    """Join on equal key columns ``on`` (and ``condition``), spreading hot keys.

    ``how`` is inner, left or left_anti. Hot keys of the left side are looked up when not given; those of
    the right side only matter to an inner join, the others need no repeated keys there. Rows with a NULL
    key, which an outer or anti join keeps, are spread as well. ``multiplies`` says that the result is much
    larger than the inputs: both sides are then partitioned in full, as partitions merged by their input
    size would be too few for the output. The key columns of the right side are dropped; other column
    names must differ.
    """
    if hot_left is None:
        hot_left = hot_keys(left, on)
    hot_right = (hot_right or {}) if how == "inner" else {}
    hot = None
    if hot_left or hot_right:
        rows = [(k, hot_left.get(k, 1), hot_right.get(k, 1)) for k in sorted({*hot_left, *hot_right})]
        hot = left.sparkSession.createDataFrame(rows, _HOT)
    renamed = right.withColumnsRenamed({name: f"_r_{name}" for name in on})
    equal = [F.col(name) == F.col(f"_r_{name}") for name in on]
    if hot is not None or how != "inner":
        r_on = [f"_r_{name}" for name in on]
        left = _spread(left, on, hot, "lefts", "rights", how != "inner").withColumnsRenamed({"lefts": "_l_i", "rights": "_l_j"})
        renamed = _spread(renamed, r_on, hot, "rights", "lefts", False).withColumnsRenamed({"lefts": "_r_i", "rights": "_r_j"})
        equal += [F.col("_l_i") == F.col("_r_i"), F.col("_l_j") == F.col("_r_j")]
    if multiplies:
        n = shuffle_partitions(left)
        left = left.repartition(n, *on, *(name for name in ("_l_i", "_l_j") if name in left.columns))
        renamed = renamed.repartition(n, *(f"_r_{name}" for name in on), *(name for name in ("_r_i", "_r_j") if name in renamed.columns))
    if condition is not None:
        equal.append(condition)
    helpers = ["_l_i", "_l_j", "_r_i", "_r_j", *(f"_r_{name}" for name in on)]
    return left.join(renamed, reduce(and_, equal), how).drop(*helpers)


def look_up(facts: DataFrame, dimension: DataFrame, on: list[str], fits: bool, reduced: bool = False) -> DataFrame:
    """Left join to a table with one row per key: broadcast when its size was checked, spread otherwise.

    ``reduced`` says that no key of ``facts`` holds many rows, so that none needs to be looked for.
    """
    if fits:
        return facts.join(F.broadcast(dimension), on, "left")
    return spread_join(facts, dimension, on, "left", hot_left={} if reduced else None)

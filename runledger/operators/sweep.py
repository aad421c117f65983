"""Running totals over time that no single task has to take alone.

A total is taken in three steps (instants within a second, seconds within an hour, hours), so that every
window group has a size fixed by the clock and not by the data: at most a million distinct microseconds
per second, 3600 seconds per hour, and the hours of the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions import epoch_second


def running_total(instants: DataFrame, value: str, alias: str, keys: list[str] | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all earlier and equal instants, per ``keys``.

    ``instants`` has one row per key and distinct ``t`` (zone-free timestamp); keys and ``value`` must not
    be NULL.
    """
    keys = keys or []
    upto = lambda order, *by: Window.partitionBy(*keys, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = lambda order, *by: Window.partitionBy(*keys, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # Keys that cannot be NULL get no extra null filters, so all steps read one and the same shuffle.
    never_null = lambda key: F.coalesce(key, F.lit(0).cast("bigint"))
    placed = instants.withColumn("_second", never_null(epoch_second(F.col("t"))))
    seconds = (
        placed.groupBy(*keys, "_second")
        .agg(F.sum(value).alias("_v"))
        .withColumn("_hour", never_null(F.floor(F.col("_second") / 3600)))
    )
    hours = (
        seconds.groupBy(*keys, "_hour")
        .agg(F.sum("_v").alias("_v"))
        .select(*keys, "_hour", F.coalesce(F.sum("_v").over(before("_hour")), F.lit(0)).alias("_before_hour"))
    )
    starts = seconds.join(hours, [*keys, "_hour"]).select(
        *keys,
        "_second",
        (F.col("_before_hour") + F.coalesce(F.sum("_v").over(before("_second", "_hour")), F.lit(0))).alias("_before_second"),
    )
    return (
        placed.withColumn("_within", F.sum(value).over(upto("t", "_second")))
        .join(starts, [*keys, "_second"])
        .withColumn(alias, F.col("_before_second") + F.col("_within"))
        .drop("_second", "_within", "_before_second")
    )

"""Runs as time intervals: how many are live at an instant, and which of them overlap.

Both questions are answered from signed counts per instant instead of comparing runs with runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.clock import Clock, check_range
from runledger.functions import as_id, epoch_second
from runledger.functions.nodes import covering_nodes, nodes_above
from runledger.operators.jobs import with_job_name
from runledger.operators.sweep import running_total
from runledger.sources.tables import Tables


# Levels of the tree over hours, 32 to a node of the next: a run of a year has at most 70 nodes.
HOUR_LEVELS = 3


def jobs_concurrency(t: Tables, clock: Clock, hours: int = 24) -> DataFrame:
    """Runs in progress at every instant of the window at which a run starts or ends, both ends included.

    Counted are runs that started in the window; the end of an earlier run is an instant as well.
    """
    check_range("hours", hours, 1, 168)
    return _concurrency(t, clock, hours).orderBy("time")


def jobs_concurrency_tail(t: Tables, clock: Clock, hours: int = 24, points: int = 50) -> DataFrame:
    """The last ``points`` instants of the concurrency curve."""
    check_range("hours", hours, 1, 168)
    return _concurrency(t, clock, hours).orderBy(F.desc("time")).limit(points).orderBy("time")


def _concurrency(t: Tables, clock: Clock, hours: int) -> DataFrame:
    started = clock.since_hours(F.col("period_start_time"), hours)
    ended = clock.since_hours(F.col("period_end_time"), hours)
    start, end = F.col("period_start_time"), F.col("period_end_time")
    # A run whose end precedes its start is live at no instant.
    counts = started & (end.isNull() | (end >= start))
    flag = lambda condition: F.when(condition, 1).otherwise(0)
    mark = lambda time, shown, n_start, n_end: F.struct(
        time.alias("t"), shown.alias("shown"), n_start.alias("n_start"), n_end.alias("n_end")
    )
    instants = (
        t.runs.filter(started | ended)
        .select(F.explode(F.array(mark(start, started, flag(counts), F.lit(0)), mark(end, ended, F.lit(0), flag(counts)))).alias("m"))
        .select("m.*")
        .filter("shown")
        .groupBy("t")
        .agg(F.sum("n_start").alias("n_start"), F.sum("n_end").alias("n_end"))
    )
    counted = running_total(instants.withColumn("_net", F.col("n_start") - F.col("n_end")), "_net", "_after")
    # Ends count up to and including their instant, so they are added back at it.
    return counted.select(F.col("t").alias("time"), (F.col("_after") + F.col("n_end")).alias("concurrent_jobs")).filter(
        "concurrent_jobs > 0"
    )


def jobs_overlaps(t: Tables, clock: Clock, hours: int = 24, limit: int = 100) -> DataFrame:
    """The ``limit`` newest pairs of runs that overlap in time, by the start of the overlap.

    The start of an overlap is the start of its later run. The number of pairs beginning at an instant
    follows from counts alone, so the few newest instants that together hold ``limit`` pairs are known
    before any pair is built. At each of them the pairs with the lowest ids consist of runs among the
    ``limit + 1`` lowest ids of their class; only those are paired. Run ids are unique among the runs
    live at an instant; rows that end before they start cannot be placed on the axis and are left out.
    """
    check_range("hours", hours, 1, 168)
    check_range("limit", limit, 1, 500)
    start, end = F.col("period_start_time"), F.col("period_end_time")
    runs = t.runs.filter(clock.since_hours(start, hours) & (end >= start))
    newest = _newest_overlap_starts(runs, limit)
    live = _lowest_live_runs(runs, newest, limit)
    left = live.select("t", *(F.col(c).alias(f"{c}_1") for c in _SIDE))
    right = live.select("t", *(F.col(c).alias(f"{c}_2") for c in _SIDE))
    pairs = (
        left.join(right, "t")
        .filter(
            (F.col("run_number_1") < F.col("run_number_2"))
            & (F.col("period_start_time_1") < F.col("period_end_time_2"))
            & (F.col("period_end_time_1") > F.col("period_start_time_2"))
            & ((F.col("kind_1") != "earlier") | (F.col("kind_2") != "earlier"))
        )
        .orderBy(F.desc("t"), "run_number_1", "run_number_2")
        .limit(limit)
    )
    return _with_pair_names(t, pairs).orderBy(F.desc("overlap_start"), "run_id_1", "run_id_2")


def jobs_misordered(t: Tables, clock: Clock, hours: int = 24) -> DataFrame:
    """How many runs of the window end before they start, and how many there are, one row.

    Such rows cannot be placed on the axis; the overlaps and the concurrency leave them out. An open run has no end yet.
    """
    check_range("hours", hours, 1, 168)
    start, end = F.col("period_start_time"), F.col("period_end_time")
    window = t.runs.filter(clock.since_hours(start, hours))
    return window.agg(F.count_if(end < start).alias("misordered_runs"), F.count("*").alias("runs"))


_SIDE = ("kind", "job_id", "workspace_id", "run_name", "run_number", "period_start_time", "period_end_time")


def _newest_overlap_starts(runs: DataFrame, limit: int) -> DataFrame:
    """The newest instants at which overlaps begin, as many as it takes for ``limit`` pairs (at most ``limit`` rows)."""
    point = F.col("period_end_time") == F.col("period_start_time")
    flag = lambda condition: F.when(condition, 1).otherwise(0)
    marks = runs.select(
        F.explode(
            F.array(
                F.struct(F.col("period_start_time").alias("t"), flag(~point).alias("n_start"), F.lit(0).alias("n_end"), flag(point).alias("n_point")),
                F.struct(F.col("period_end_time").alias("t"), F.lit(0).alias("n_start"), flag(~point).alias("n_end"), F.lit(0).alias("n_point")),
            )
        ).alias("m")
    ).select("m.*")
    # Always true, but it names every count, so all steps of the running total read the same aggregate.
    instants = (
        marks.groupBy("t")
        .agg(*(F.sum(c).alias(c) for c in ("n_start", "n_end", "n_point")))
        .filter("n_start + n_end + n_point > 0")
    )
    counted = running_total(instants.withColumn("_net", F.col("n_start") - F.col("n_end")), "_net", "_after")
    earlier = F.col("_after") - F.col("n_start")
    pairs = F.col("n_start") * (F.col("n_start") - 1) / 2 + (F.col("n_start") + F.col("n_point")) * earlier
    newest = counted.select("t", pairs.alias("pairs")).filter("pairs > 0").orderBy(F.desc("t")).limit(limit)
    newer = Window.partitionBy().orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    return newest.withColumn("_newer", F.coalesce(F.sum("pairs").over(newer), F.lit(0))).filter(F.col("_newer") < limit).select("t")


def _lowest_live_runs(runs: DataFrame, instants: DataFrame, limit: int) -> DataFrame:
    """Per instant and class (starting, point, earlier) the runs with the ``limit + 1`` lowest ids."""
    start, end = F.col("period_start_time"), F.col("period_end_time")
    kind = F.when(start < F.col("t"), "earlier").when(end == start, "point").otherwise("starting")
    lowest = Window.partitionBy("t", "kind").orderBy("run_number")
    hit = (start <= F.col("t")) & ((end > F.col("t")) | ((start == F.col("t")) & (end == start)))
    # A run is a few nodes of a tree over hours; it meets an instant at the one node that both have, or not at all. At most
    # ``limit`` instants, each with a node per level, are broadcast.
    hour = lambda time: F.floor(epoch_second(time) / 3600)
    placed = runs.withColumn("_b", hour(start)).withColumn("_c", hour(end))
    placed = placed.withColumn("_node", F.explode(covering_nodes(F.col("_b"), F.col("_c"), HOUR_LEVELS))).drop("_b", "_c")
    above = instants.withColumn("_hour", hour(F.col("t"))).select("t", F.explode(nodes_above(F.col("_hour"), HOUR_LEVELS)).alias("_node"))
    return (
        placed.join(F.broadcast(above), "_node")
        .filter(hit)
        .withColumn("kind", kind)
        .withColumn("run_number", as_id(F.col("run_id")))
        .withColumn("_rn", F.row_number().over(lowest))
        .filter(F.col("_rn") <= limit + 1)
        .select("t", *_SIDE)
    )


def _with_pair_names(t: Tables, pairs: DataFrame) -> DataFrame:
    for side in ("1", "2"):
        keyed = pairs.withColumnsRenamed({f"job_id_{side}": "job_id", f"workspace_id_{side}": "workspace_id"})
        pairs = (
            with_job_name(t, keyed)
            .withColumn(f"job_name_{side}", F.coalesce("job_name", f"run_name_{side}"))
            .withColumn(f"job_id_{side}", as_id(F.col("job_id")))
            .drop("job_id", "workspace_id", "job_name", "creator_user_name")
        )
    return pairs.select(
        "job_id_1",
        "job_name_1",
        F.col("run_number_1").alias("run_id_1"),
        "job_id_2",
        "job_name_2",
        F.col("run_number_2").alias("run_id_2"),
        F.greatest("period_start_time_1", "period_start_time_2").alias("overlap_start"),
        F.least("period_end_time_1", "period_end_time_2").alias("overlap_end"),
    )

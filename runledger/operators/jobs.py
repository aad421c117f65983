"""Run monitoring: lists, counts and per-job grids."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger import fixed_values as V
from runledger.clock import Clock, check_range
from runledger.functions import as_id, duration_label, is_bad, is_open, is_succeeded, pct, seconds_between, status_class
from runledger.operators.skew import look_up
from runledger.sources.tables import Tables

JOB_KEY = ["job_id", "workspace_id"]


def with_job_name(t: Tables, facts: DataFrame, reduced: bool = False) -> DataFrame:
    """Adds ``job_name`` and ``creator_user_name`` of the definition, NULL when there is none.

    ``reduced`` facts are already counted per job, or a short list.
    """
    names = t.jobs.select(*JOB_KEY, F.col("name").alias("job_name"), "creator_user_name")
    return look_up(facts, names, JOB_KEY, t.jobs_fit, reduced)


def recent_runs(t: Tables, clock: Clock, days: int) -> DataFrame:
    return t.runs.filter(clock.since_days(F.col("period_start_time"), days))


def _newest_first():
    return F.desc("start_time"), F.asc("run_id")


def _listed(df: DataFrame) -> DataFrame:
    """The public columns of a run."""
    return df.select(
        as_id(F.col("job_id")).alias("job_id"),
        "job_name",
        as_id(F.col("run_id")).alias("run_id"),
        "result_state",
        "run_type",
        F.col("period_start_time").alias("start_time"),
        F.col("period_end_time").alias("end_time"),
        F.col("execution_duration_seconds").alias("execution_duration"),
        "creator_user_name",
    )


def jobs_runs(t: Tables, clock: Clock, days: int = 7, limit: int = 100, status: str | None = None) -> DataFrame:
    """Newest runs with job name and creator."""
    check_range("days", days, 1, 90)
    check_range("limit", limit, 1, 1000)
    runs = recent_runs(t, clock, days)
    if status:
        runs = runs.filter(F.col("result_state") == status)
    # Each run has at most one definition, so the cut can precede the name lookup.
    newest = runs.orderBy(F.desc("period_start_time"), as_id(F.col("run_id")).asc()).limit(limit)
    return _listed(with_job_name(t, newest)).orderBy(*_newest_first())


def jobs_summary(t: Tables, clock: Clock, days: int = 7) -> DataFrame:
    """Counts by outcome and the success rate, one row."""
    check_range("days", days, 1, 90)
    state = F.col("result_state")
    counts = recent_runs(t, clock, days).agg(
        F.count("*").alias("total_runs"),
        F.count_if(is_succeeded(state)).alias("succeeded"),
        F.count_if(is_bad(state)).alias("failed"),
        F.count_if(is_open(state)).alias("running"),
    )
    return counts.withColumn("success_rate", pct(F.col("succeeded"), F.col("total_runs")))


def jobs_daily(t: Tables, clock: Clock, days: int = 30) -> DataFrame:
    """Counts by outcome per calendar day."""
    check_range("days", days, 1, 90)
    state = F.col("result_state")
    return (
        recent_runs(t, clock, days)
        .groupBy(F.to_date("period_start_time").alias("date"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(is_succeeded(state)).alias("succeeded"),
            F.count_if(is_bad(state)).alias("failed"),
        )
        .orderBy("date")
    )


def jobs_by_type(t: Tables, clock: Clock, days: int = 7) -> DataFrame:
    """Run counts per type. The label is applied after grouping, so a real ``UNKNOWN`` stays apart from NULL."""
    check_range("days", days, 1, 90)
    return (
        recent_runs(t, clock, days)
        .groupBy("run_type")
        .count()
        .withColumn("run_type", F.coalesce("run_type", F.lit(V.UNKNOWN_RUN_TYPE)))
        .orderBy(F.desc("count"), "run_type")
    )


def share_of(df: DataFrame, value: str, alias: str = "share_pct") -> DataFrame:
    """Adds each row's percentage of the column total."""
    # Groups of a report: a row per type or department, so one window over all of them is small.
    total = F.sum(value).over(Window.partitionBy())
    return df.withColumn(alias, F.when(total > 0, F.round(F.col(value) * F.lit(100.0) / total, 2)).otherwise(F.lit(0.0)))


def _matrix_rows(t: Tables, clock: Clock, limit: int, runs_per_job: int) -> DataFrame:
    """Newest runs of the first ``limit`` jobs by id, with the id as given (``job_key``) and as a number.

    Runs without a job id belong to no job; ids that are no numbers are jobs of their own, before all numbers.
    """
    check_range("limit", limit, 1, 200)
    check_range("runs_per_job", runs_per_job, 1, 50)
    runs = recent_runs(t, clock, 30).filter("job_id IS NOT NULL").withColumn("job_number", as_id(F.col("job_id")))
    # Ids of the shown jobs first (at most ``limit`` rows), so only their runs are ranked.
    shown = runs.select("job_number", "job_id").distinct().orderBy("job_number", "job_id").limit(limit).select("job_id")
    newest = Window.partitionBy("job_id").orderBy(F.desc("period_start_time"), as_id(F.col("run_id")).desc())
    ranked = (
        runs.join(F.broadcast(shown), "job_id", "left_semi")
        .withColumn("rn", F.row_number().over(newest))
        .filter(F.col("rn") <= runs_per_job)
    )
    return with_job_name(t, ranked).select(
        F.col("job_id").alias("job_key"),
        F.col("job_number").alias("job_id"),
        "job_name",
        as_id(F.col("run_id")).alias("run_id"),
        "result_state",
        F.col("period_start_time").alias("start_time"),
        F.col("execution_duration_seconds").alias("duration_seconds"),
        "rn",
    )


def jobs_matrix_flat(t: Tables, clock: Clock, limit: int = 50, runs_per_job: int = 10) -> DataFrame:
    """Newest runs of the first ``limit`` jobs by id, numbered per job."""
    return _matrix_rows(t, clock, limit, runs_per_job).orderBy("job_id", "job_key", "rn").drop("job_key")


def jobs_matrix(
    t: Tables, clock: Clock, limit: int = 50, runs_per_job: int = 10, search: str | None = None
) -> DataFrame:
    """One row per job with its newest runs nested; a group holds at most ``runs_per_job`` runs."""
    run = F.struct("rn", "job_name", "run_id", "result_state", "start_time", F.col("duration_seconds").cast("double").alias("duration_seconds"))
    grid = (
        _matrix_rows(t, clock, limit, runs_per_job)
        .groupBy("job_key", "job_id")
        .agg(F.array_sort(F.collect_list(run)).alias("runs"))
        .select(
            "job_key",
            "job_id",
            _display_name(F.col("runs")[0]["job_name"], F.col("job_key")).alias("job_name"),
            F.transform("runs", lambda r: r.dropFields("rn", "job_name")).alias("runs"),
        )
    )
    if search:
        name_hit = F.contains(F.lower("job_name"), F.lit(search.lower()))
        grid = grid.filter(name_hit | F.contains(F.col("job_key"), F.lit(search)))
    return grid.orderBy("job_id", "job_key").drop("job_key")


def _display_name(name, job_id):
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Job "), job_id.cast("string")))


def jobs_search(
    t: Tables,
    clock: Clock,
    q: str = "",
    days: int = 7,
    status: str | None = None,
    page: int = 0,
    page_size: int = 25,
) -> DataFrame:
    """One page of the runs whose job name, job id or creator contains ``q`` in any case."""
    check_range("days", days, 1, 90)
    check_range("page", page, 0, 10_000)
    check_range("page_size", page_size, 1, 100)
    runs = recent_runs(t, clock, days)
    if status:
        runs = runs.filter(F.col("result_state") == status)
    listed = _listed(with_job_name(t, runs))
    needle = F.lit(q.lower())
    hits = listed.filter(
        F.contains(F.lower("job_name"), needle)
        | F.contains(F.col("job_id").cast("string"), needle)
        | F.contains(F.lower("creator_user_name"), needle)
    )
    return (
        hits.orderBy(*_newest_first())
        .offset(page * page_size)
        .limit(page_size)
        .withColumn("status_class", status_class(F.col("result_state")))
        .withColumn("duration_label", duration_label(F.col("execution_duration")))
    )


def jobs_timeline(t: Tables, clock: Clock, hours: int = 24, rows: int = 30) -> DataFrame:
    """The newest ``rows`` runs laid out on a time axis from the earliest of them to now."""
    check_range("hours", hours, 1, 168)
    check_range("rows", rows, 1, 1000)
    listed = jobs_runs(t, clock, days=ceil(hours / 24), limit=rows).filter(F.col("start_time").isNotNull())
    shown = listed.orderBy(*_newest_first()).limit(rows)
    whole = Window.partitionBy()  # at most ``rows`` rows
    seconds = lambda a, b: seconds_between(F.col(a), F.col(b))
    placed = (
        shown.withColumn("end_time", F.coalesce("end_time", clock.now()))
        .withColumn("_from", F.min("start_time").over(whole))
        .withColumn("_now", clock.now())
    )
    span = seconds("_from", "_now")
    return (
        placed.withColumn("duration", seconds("start_time", "end_time"))
        .withColumn("display_name", _display_name(F.col("job_name"), F.col("job_id")))
        .withColumn("left_pct", F.when(span > 0, F.round(seconds("_from", "start_time") * 100 / span, 4)))
        .withColumn("width_pct", F.when(span > 0, F.round(F.col("duration") * 100 / span, 4)))
        .drop("_from", "_now")
        .orderBy(*_newest_first())
    )


def jobs_active_count(t: Tables, clock: Clock) -> DataFrame:
    """Number of definitions that are not deleted."""
    return t.jobs.filter(F.col("delete_time").isNull()).agg(F.count("*").alias("active_jobs"))


def jobs_longest(t: Tables, clock: Clock, days: int = 7, limit: int = 10) -> DataFrame:
    """Longest finished runs."""
    check_range("days", days, 1, 90)
    runs = recent_runs(t, clock, days).filter(F.col("execution_duration_seconds").isNotNull())
    longest = runs.orderBy(F.desc("execution_duration_seconds"), as_id(F.col("run_id")).asc()).limit(limit)
    return _listed(with_job_name(t, longest)).orderBy(F.desc("execution_duration"), "run_id")


def jobs_status_labels(t: Tables, clock: Clock, days: int = 30) -> DataFrame:
    """Run counts per state, display class and duration label."""
    return (
        recent_runs(t, clock, days)
        .groupBy(
            "result_state",
            status_class(F.col("result_state")).alias("status_class"),
            duration_label(F.col("execution_duration_seconds")).alias("duration_label"),
        )
        .agg(F.count("*").alias("runs"))
    )

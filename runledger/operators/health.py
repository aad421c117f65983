"""Job health: failures, overlong runs, anomalies, retries, SLA and duration percentiles.

Where a result is grouped by (job id, job name), runs are first reduced per job definition and the name
is looked up for the reduced rows; a job that dominates the timeline is thus one small group at the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.clock import Clock, check_range, ntz
from runledger.functions import as_id, epoch_second, is_bad, is_open, is_succeeded, pct
from runledger.operators.jobs import JOB_KEY, recent_runs, with_job_name
from runledger.operators.skew import spread_join
from runledger.sources.tables import Tables

NAMED_JOB = ["job_id", "job_name"]
_DURATION = "execution_duration_seconds"


def _by_name(t: Tables, reduced: DataFrame):
    return with_job_name(t, reduced, reduced=True).groupBy(*NAMED_JOB)


def _failed_jobs(t: Tables, clock: Clock, days: int = 7, min_runs: int = 3) -> DataFrame:
    """All jobs with failures and enough runs."""
    check_range("days", days, 1, 90)
    check_range("min_runs", min_runs, 1)
    bad = is_bad(F.col("result_state"))
    reduced = recent_runs(t, clock, days).groupBy(*JOB_KEY).agg(
        F.count("*").alias("n"),
        F.count_if(bad).alias("bad"),
        F.max(F.when(bad, F.col("period_start_time"))).alias("last"),
    )
    jobs = (
        _by_name(t, reduced)
        .agg(F.sum("n").alias("total_runs"), F.sum("bad").alias("failed_runs"), F.max("last").alias("last_failure"))
        .filter((F.col("total_runs") >= min_runs) & (F.col("failed_runs") > 0))
    )
    return jobs.select(
        as_id(F.col("job_id")).alias("job_id"),
        "job_name",
        "total_runs",
        "failed_runs",
        pct(F.col("total_runs") - F.col("failed_runs"), F.col("total_runs")).alias("success_rate"),
        "last_failure",
    )


def health_failed_jobs(t: Tables, clock: Clock, days: int = 7, min_runs: int = 3, limit: int = 20) -> DataFrame:
    """Jobs with failures and enough runs, most failures first."""
    check_range("limit", limit, 1, 100)
    return _failed_jobs(t, clock, days, min_runs).orderBy(F.desc("failed_runs"), "job_id", "job_name").limit(limit)


def job_success_rates(t: Tables, clock: Clock, days: int = 7) -> DataFrame:
    """Success rate of every job."""
    check_range("days", days, 1, 90)
    state = F.col("result_state")
    reduced = recent_runs(t, clock, days).groupBy(*JOB_KEY).agg(
        F.count("*").alias("n"), F.count_if(is_succeeded(state)).alias("ok"), F.count_if(is_bad(state)).alias("bad")
    )
    return (
        _by_name(t, reduced)
        .agg(F.sum("n").alias("total_runs"), F.sum("ok").alias("succeeded"), F.sum("bad").alias("failed_runs"))
        .withColumn("success_rate", pct(F.col("succeeded"), F.col("total_runs")))
        .withColumn("job_id", as_id(F.col("job_id")))
    )


def health_prolonged(t: Tables, clock: Clock, warning: float = 1.5, critical: float = 2.0) -> DataFrame:
    """Open runs older than their job's usual duration allows; 300 s where a job has no history."""
    check_range("warning", warning, 1)
    check_range("critical", critical, 1)
    usual = (
        recent_runs(t, clock, 30)
        .filter(is_succeeded(F.col("result_state")))
        .groupBy("job_id")
        .agg(F.avg(_DURATION).alias("usual"))
    )
    age = epoch_second(clock.now()) - epoch_second(F.col("period_start_time"))
    started = (
        t.runs.filter(is_open(F.col("result_state")) & (F.col("period_start_time") < clock.now()))
        .select(*JOB_KEY, "run_id", "period_start_time")
        .withColumn("age", age)
    )
    late = spread_join(started, usual, ["job_id"], "left").filter(
        F.col("age") > F.coalesce(F.col("usual") * F.lit(float(warning)), F.lit(300.0))
    )
    average = F.coalesce("usual", F.lit(0.0))
    return with_job_name(t, late).select(
        as_id(F.col("job_id")).alias("job_id"),
        "job_name",
        as_id(F.col("run_id")).alias("run_id"),
        F.col("period_start_time").alias("start_time"),
        F.col("age").cast("double").alias("duration_seconds"),
        average.alias("avg_duration_seconds"),
        F.when(F.col("age") > average * F.lit(float(critical)), "critical").otherwise("warning").alias("status"),
    ).orderBy(F.desc("duration_seconds"), "run_id")


def _anomalies(t: Tables, clock: Clock, days: int = 7, baseline_days: int = 30, z_threshold: float = 2.0) -> DataFrame:
    """All jobs whose recent mean duration is far from their baseline, with the distance ``z``."""
    check_range("days", days, 1, 30)
    check_range("baseline_days", baseline_days, 7, 90)
    check_range("z_threshold", z_threshold, 1)
    state = F.col("result_state")
    finished = is_succeeded(state) | is_bad(state)
    recent = (
        recent_runs(t, clock, days)
        .filter(finished)
        .groupBy(*JOB_KEY)
        .agg(F.sum(_DURATION).alias("total"), F.count(_DURATION).alias("n"))
    )
    recent = _by_name(t, recent).agg((F.sum("total") / F.sum("n")).alias("current"))
    start = F.col("period_start_time")
    baseline = (
        t.runs.filter((start >= ntz(clock.midnight(baseline_days))) & (start < ntz(clock.midnight(days))) & finished)
        .groupBy("job_id")
        .agg(F.avg(_DURATION).alias("base"), F.stddev_samp(_DURATION).alias("sd"), F.count("*").alias("n"))
        .filter("n >= 5 AND sd > 0")
        .drop("n")
    )
    z = F.col("z")
    return (
        recent.join(baseline, "job_id")
        .withColumn("z", (F.col("current") - F.col("base")) / F.col("sd"))
        .filter(F.abs(z) >= z_threshold)
    )


def health_anomalies(
    t: Tables, clock: Clock, days: int = 7, baseline_days: int = 30, z_threshold: float = 2.0, limit: int = 20
) -> DataFrame:
    """Jobs whose recent mean duration is far from their baseline, in baseline standard deviations."""
    check_range("limit", limit, 1, 100)
    z = F.col("z")
    return (
        _anomalies(t, clock, days, baseline_days, z_threshold)
        .orderBy(F.abs(z).desc(), as_id(F.col("job_id")).asc(), "job_name")
        .limit(limit)
        .select(
            as_id(F.col("job_id")).alias("job_id"),
            "job_name",
            F.lit("duration").alias("metric"),
            F.round("current", 2).alias("current_value"),
            F.round("base", 2).alias("avg_value"),
            F.round("sd", 2).alias("std_dev"),
            F.round(z, 2).alias("z_score"),
            F.when(F.abs(z) >= 3, "critical").otherwise("warning").alias("severity"),
        )
    )


def health_retries(t: Tables, clock: Clock, days: int = 7, limit: int = 20) -> DataFrame:
    """Jobs that both failed and succeeded in the window; failures are read as retried attempts."""
    check_range("days", days, 1, 90)
    check_range("limit", limit, 1, 100)
    state = F.col("result_state")
    runs = (
        recent_runs(t, clock, days)
        .groupBy(*JOB_KEY, as_id(F.col("run_id")).alias("run_number"))
        .agg(F.count_if(is_bad(state)).alias("bad"), F.count_if(is_succeeded(state)).alias("ok"))
    )
    jobs = (
        _by_name(t, runs)
        .agg(
            F.countDistinct("run_number").alias("unique_runs"),
            F.sum("bad").alias("retry_attempts"),
            F.sum("ok").alias("ok"),
        )
        .filter("retry_attempts > 0 AND ok > 0")
    )
    return (
        jobs.select(
            as_id(F.col("job_id")).alias("job_id"),
            "job_name",
            "unique_runs",
            F.col("unique_runs").alias("total_attempts"),
            "retry_attempts",
            F.col("unique_runs").alias("max_attempts"),
            pct(F.col("retry_attempts"), F.greatest("unique_runs", F.lit(1))).alias("retry_rate_pct"),
        )
        .orderBy(F.desc("retry_attempts"), "job_id", "job_name")
        .limit(limit)
    )


def duration_counts(runs: DataFrame) -> DataFrame:
    """Rows per job definition and duration: whole seconds repeat, so this is far smaller than the runs."""
    return runs.groupBy(*JOB_KEY, F.col(_DURATION).alias("d")).agg(F.count("*").alias("c"))


def _sla(t: Tables, clock: Clock, days: int = 7, sla_multiplier: float = 2.0) -> DataFrame:
    """Share of each job's successful runs within a multiple of its mean duration.

    Violations are counted per job id against the mean of every name the id has run under.
    """
    check_range("days", days, 1, 90)
    check_range("sla_multiplier", sla_multiplier, 1)
    ran = duration_counts(recent_runs(t, clock, days).filter(is_succeeded(F.col("result_state"))))
    c, d = F.col("c"), F.col("d")
    stats = _by_name(t, ran).agg(
        F.sum("c").alias("total_runs"), (F.sum(d * c) / F.sum(F.when(d.isNotNull(), c))).alias("mean")
    )
    over = (
        ran.groupBy("job_id", "d")
        .agg(F.sum("c").alias("c"))
        .join(stats.select("job_id", "mean"), "job_id")
        .filter(d > F.col("mean") * F.lit(float(sla_multiplier)))
        .groupBy("job_id")
        .agg(F.sum("c").alias("over"))
    )
    violations = F.coalesce("over", F.lit(0))
    rate = F.round((F.col("total_runs") - F.col("sla_violations")) * F.lit(100.0) / F.col("total_runs"), 2)
    shown = F.col("compliance_rate_pct")
    return (
        stats.join(over, "job_id", "left")
        .select(
            as_id(F.col("job_id")).alias("job_id"),
            "job_name",
            "total_runs",
            F.coalesce(F.round("mean", 2), F.lit(0.0)).alias("avg_duration_seconds"),
            violations.alias("sla_violations"),
        )
        .withColumn("compliance_rate_pct", rate)
        .withColumn("status", F.when(shown >= 95, "compliant").when(shown >= 80, "at_risk").otherwise("non_compliant"))
    )


def health_sla(t: Tables, clock: Clock, days: int = 7, sla_multiplier: float = 2.0, limit: int = 50) -> DataFrame:
    """Jobs by their share of successful runs within a multiple of their mean duration, most violations first."""
    check_range("limit", limit, 1, 500)
    order = F.desc("sla_violations"), F.desc("total_runs"), "job_id", "job_name"
    return _sla(t, clock, days, sla_multiplier).orderBy(*order).limit(limit)


PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def _percentiles(value: Column, weight: Column) -> Column:
    """Interpolated percentiles of a value that occurs ``weight`` times per row."""
    return F.percentile(value, list(PERCENTILES), weight)


def health_percentiles(t: Tables, clock: Clock, days: int = 30, limit: int = 50) -> DataFrame:
    """Interpolated duration percentiles of successful runs, slowest median first."""
    check_range("days", days, 1, 90)
    ran = duration_counts(recent_runs(t, clock, days).filter(is_succeeded(F.col("result_state"))))
    jobs = (
        _by_name(t, ran)
        .agg(F.sum("c").alias("run_count"), _percentiles(F.col("d"), F.col("c")).alias("p"))
        .filter("run_count >= 5")
    )
    shown = [
        F.coalesce(F.round(F.col("p")[i], 2), F.lit(0.0)).alias(f"p{round(q * 100)}_seconds") for i, q in enumerate(PERCENTILES)
    ]
    return (
        jobs.select(as_id(F.col("job_id")).alias("job_id"), "job_name", "run_count", *shown)
        .orderBy(F.desc("p50_seconds"), "job_id", "job_name")
        .limit(limit)
    )


def job_health_metrics(t: Tables, clock: Clock, days: int = 30) -> DataFrame:
    """Outcome counts, duration statistics and a health verdict per job."""
    state = F.col("result_state")
    runs = recent_runs(t, clock, days)
    ran = runs.groupBy(*JOB_KEY, F.col(_DURATION).alias("d")).agg(
        F.count("*").alias("c"), F.count_if(is_succeeded(state)).alias("ok"), F.count_if(state == "FAILED").alias("bad")
    )
    c, d = F.col("c"), F.col("d")
    exact = lambda column: column.cast("decimal(38,0)")
    stats = _by_name(t, ran).agg(
        F.sum("c").alias("total_runs"),
        F.sum("ok").alias("success_count"),
        F.sum("bad").alias("failed_count"),
        F.sum(F.when(d.isNotNull(), c)).alias("n"),
        F.sum(d * c).alias("s"),
        F.sum(exact(d.cast("decimal(18,0)") * d.cast("decimal(18,0)")) * c).alias("ss"),
        _percentiles(d, c).alias("p"),
    )
    n, s = F.col("n"), F.col("s")
    # Sums of whole seconds are exact, so is n * sum of squares - square of sum.
    spread = (exact(n) * F.col("ss").cast("decimal(38,0)") - exact(s) * exact(s)).cast("double")
    rate = F.col("success_count") / F.col("total_runs")
    return stats.select(
        as_id(F.col("job_id")).alias("job_id"),
        "job_name",
        "total_runs",
        "success_count",
        "failed_count",
        pct(F.col("success_count"), F.col("total_runs")).alias("success_rate_pct"),
        F.round(s / n, 2).alias("avg_duration_seconds"),
        F.when(n > 1, F.round(F.sqrt(spread / (n.cast("double") * (n - 1))), 2)).alias("stddev_duration_seconds"),
        *(F.round(F.col("p")[i], 2).alias(f"p{round(q * 100)}_duration") for i, q in enumerate(PERCENTILES)),
        F.when(rate >= 0.95, "HEALTHY").when(rate >= 0.80, "WARNING").otherwise("CRITICAL").alias("health_status"),
    )


def health_score(t: Tables, clock: Clock) -> DataFrame:
    """Share of compliant jobs among all with an SLA row, with the full sizes of the health lists, one row."""
    sized = {
        "sla": _sla(t, clock).select((F.col("status") == "compliant").alias("good")),
        "failed": _failed_jobs(t, clock).select(F.lit(False).alias("good")),
        "prolonged": health_prolonged(t, clock).select(F.lit(False).alias("good")),
        "anomalies": _anomalies(t, clock).select(F.lit(False).alias("good")),
    }
    rows = None
    for kind, df in sized.items():
        tagged = df.withColumn("kind", F.lit(kind))
        rows = tagged if rows is None else rows.unionByName(tagged)
    count = lambda kind: F.count_if(F.col("kind") == kind)
    compliant = F.count_if(F.col("good"))
    return rows.agg(
        F.when(count("sla") == 0, 100).otherwise(F.floor(compliant * 100.0 / count("sla") + 0.5)).cast("bigint").alias("health_score"),
        count("sla").alias("sla_jobs"),
        count("failed").alias("failed_jobs"),
        count("prolonged").alias("prolonged_runs"),
        count("anomalies").alias("anomalies"),
    )

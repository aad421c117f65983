"""Reports over attributed usage.

Each takes ``attributed`` to share one attribution between reports: pass the result of
``materialize`` (or of ``cost_by_tags``); without it the report attributes the days it needs.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger import fixed_values as V
from runledger.clock import Clock, check_range
from runledger.functions import pct, usd
from runledger.operators import costs
from runledger.operators.attribution import TAG_COLUMNS, WINDOW_DAYS, attribute_usage, attributed_days, attribution_totals, note_days, unmatched_rows
from runledger.operators.factorised import DIMENSIONS, FactorisedTotals, attributed_totals, totals_of
from runledger.plans.views import weekly_trends, weekly_trends_of
from runledger.sources.tables import Tables


def materialize(t: Tables, clock: Clock, path: str, days: int = WINDOW_DAYS) -> DataFrame:
    """Write attributed usage once, partitioned by date, and return the stored table.

    The rebalancing splits a busy date into files of the advised size and merges small ones.
    """
    attributed = attribute_usage(t, clock, days)
    attributed.hint("rebalance", F.col("usage_date")).write.mode("overwrite").partitionBy("usage_date").parquet(path)
    return note_days(t.spark.read.schema(attributed.schema).parquet(path), days)


def _attributed(t: Tables, clock: Clock, days: int, attributed: DataFrame | None) -> DataFrame:
    if attributed is None:
        return attribute_usage(t, clock, days)
    held = attributed_days(attributed)
    if held is not None and held < days:
        raise ValueError(f"attributed: holds {held} days of usage, {days} are needed")
    return attributed.filter(clock.on_dates(F.col("usage_date"), days))


def _with_daily_runs(totals: FactorisedTotals, keys: list[str]) -> DataFrame:
    """Totals per ``keys`` with ``job_runs_distinct``, and ``job_runs``, which adds up the runs of each date and all tag dimensions."""
    whole = totals.grouped(keys).withColumnRenamed("runs", "job_runs_distinct")
    daily = totals.grouped(DIMENSIONS, lambda day: day).groupBy("department", "project_code").agg(F.sum("runs").alias("job_runs"))
    rows = whole.unionByName(daily, allowMissingColumns=True)
    sums = [F.sum(name).alias(name) for name in ("c", "q", "job_runs", "job_runs_distinct")]
    return rows.groupBy(*keys).agg(*sums, F.countDistinct("project_code").alias("project_count"))


def costs_by_project(t: Tables, clock: Clock, days: int = 30, attributed: DataFrame | None = None) -> DataFrame:
    check_range("days", days, 1, 90)
    if attributed is not None:
        return costs.roll_up_projects(_attributed(t, clock, days, attributed))
    return costs.named_projects(_with_daily_runs(attributed_totals(t, clock, days), ["project_code", "department"]))


def costs_by_department(t: Tables, clock: Clock, days: int = 30, attributed: DataFrame | None = None) -> DataFrame:
    check_range("days", days, 1, 90)
    if attributed is not None:
        return costs.roll_up_departments(_attributed(t, clock, days, attributed))
    return costs.named_departments(_with_daily_runs(attributed_totals(t, clock, days), ["department"]))


def costs_trends(t: Tables, clock: Clock, weeks: int = 8, attributed: DataFrame | None = None) -> DataFrame:
    check_range("weeks", weeks, 1, 52)
    # A week is shown when its Monday is in range, so no earlier usage date is needed.
    days = weeks * 7
    trends = weekly_trends_of(attributed_totals(t, clock, days)) if attributed is None else weekly_trends(_attributed(t, clock, days, attributed))
    return costs.roll_up_weeks(trends, clock, weeks)


def _status_totals(t: Tables, clock: Clock, days: int, attributed: DataFrame | None) -> DataFrame:
    """Rows and cost per match status; counted without building the rows where none are given."""
    if attributed is None:
        return attribution_totals(t, clock, days)
    rows = _attributed(t, clock, days, attributed)
    return rows.groupBy("correlation_status").agg(F.count("*").alias("n"), F.sum("estimated_cost_usd").alias("c"))


def _of(status: str, value: str):
    return F.sum(F.when(F.col("correlation_status") == status, F.col(value)))


def correlation_breakdown(t: Tables, clock: Clock, days: int = 7, attributed: DataFrame | None = None) -> DataFrame:
    """Rows and cost per match status."""
    check_range("days", days, 1, 90)
    totals = _status_totals(t, clock, days, attributed)
    return totals.select(F.col("correlation_status").alias("status"), F.col("n").alias("count"), usd(F.col("c")).alias("cost"))


def correlation_rate(t: Tables, clock: Clock, days: int = 7, attributed: DataFrame | None = None) -> DataFrame:
    """Share of attributed rows, one row."""
    check_range("days", days, 1, 90)
    none = F.lit(0).cast("bigint")
    counts = _status_totals(t, clock, days, attributed).agg(
        F.coalesce(F.sum("n"), none).alias("total_records"),
        F.coalesce(_of(V.MATCHED, "n"), none).alias("matched"),
        F.coalesce(_of(V.UNMATCHED, "n"), none).alias("unmatched"),
    )
    return counts.withColumn("correlation_rate_pct", pct(F.col("matched"), F.col("total_records")))


def costs_untagged_pct(t: Tables, clock: Clock, days: int = 30, attributed: DataFrame | None = None) -> DataFrame:
    """Percentage of attributed cost that no tag record explains, one row."""
    check_range("days", days, 1, 90)
    sums = _status_totals(t, clock, days, attributed).agg(F.sum("c").alias("all"), _of(V.UNMATCHED, "c").alias("open"))
    whole, part = F.col("all").cast("double"), F.coalesce(F.col("open").cast("double"), F.lit(0.0))
    return sums.select(
        usd(F.col("all")).alias("total_cost"),
        usd(F.col("open")).alias("untagged_cost"),
        pct(part, whole).alias("untagged_pct"),
    )


def correlation_by_pipeline(t: Tables, clock: Clock, days: int = 30, attributed: DataFrame | None = None) -> DataFrame:
    """Match counts per calling pipeline; usage without a tag record is one group."""
    check_range("days", days, 1, 90)
    if attributed is None:
        per_dimension = attributed_totals(t, clock, days).grouped(["adf_pipeline_name"], runs=False)
    else:
        totals = totals_of(_attributed(t, clock, days, attributed), F.col("correlation_status") == V.MATCHED)
        per_dimension = totals.named(totals.parts.groupBy("_dim").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    return (
        per_dimension.groupBy("adf_pipeline_name")
        .agg((F.sum("yes") + F.sum("no")).alias("total_records"), F.sum("yes").alias("matched"))
        .select(
            F.coalesce("adf_pipeline_name", F.lit(V.DIRECT_EXECUTION)).alias("pipeline_name"),
            "total_records",
            "matched",
            pct(F.col("matched"), F.col("total_records")).alias("correlation_rate_pct"),
        )
        .orderBy(F.desc("total_records"), "pipeline_name")
    )


def costs_by_pipeline(t: Tables, clock: Clock, days: int = 30, attributed: DataFrame | None = None) -> DataFrame:
    """Cost and distinct runs per calling pipeline."""
    check_range("days", days, 1, 90)
    if attributed is None:
        totals = attributed_totals(t, clock, days).grouped(["adf_pipeline_name"]).withColumnRenamed("runs", "job_runs")
    else:
        rows = _attributed(t, clock, days, attributed).groupBy("adf_pipeline_name")
        totals = rows.agg(F.sum("estimated_cost_usd").alias("c"), F.sum("dbus").alias("q"), F.countDistinct("job_run_id").alias("job_runs"))
    return (
        totals.select(
            F.coalesce("adf_pipeline_name", F.lit(V.DIRECT_EXECUTION)).alias("pipeline_name"),
            usd(F.col("c")).alias("total_cost"),
            usd(F.col("q")).alias("total_dbus"),
            "job_runs",
        )
        .orderBy(F.desc("total_cost"), "pipeline_name")
    )


def tags_unmatched(t: Tables, clock: Clock, days: int = 7, limit: int = 50, attributed: DataFrame | None = None) -> DataFrame:
    """Most expensive recent usage without a tag record."""
    check_range("days", days, 1, 30)
    check_range("limit", limit, 1, 200)
    if attributed is None:
        rows = unmatched_rows(t, clock, days)
    else:
        rows = _attributed(t, clock, days, attributed).filter(F.col("correlation_status") == V.UNMATCHED).drop(*TAG_COLUMNS)
    return (
        rows.orderBy(F.desc("estimated_cost_usd"), "usage_date", "job_run_id", "sku_name", "usage_start_time")
        .limit(limit)
        .select(
            "usage_date",
            "workspace_id",
            "job_id",
            "job_run_id",
            "notebook_path",
            "sku_name",
            usd(F.col("dbus")).alias("dbus"),
            usd(F.col("estimated_cost_usd"), 4).alias("estimated_cost_usd"),
        )
    )

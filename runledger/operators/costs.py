"""Cost breakdowns of metered usage.

Amounts are added up per SKU and cloud before a price is looked up, so the lookup sees a few rows however
large the usage is. Distinct counts of a top-k report are taken for the reported keys only.
"""

from __future__ import annotations

from datetime import timedelta
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger import fixed_values as V
from runledger.clock import Clock, check_range
from runledger.functions import sku_category, sku_short_label, usd
from runledger.operators.pricing import flat_price, with_current_price
from runledger.sources.tables import Tables

SUMMARY_KEYS = ["usage_date", "project_code", "cost_center", "department", "environment", "application_name", "adf_pipeline_name"]

SKU_KEY = ["sku_name", "cloud"]


def recent_usage(t: Tables, clock: Clock, days: int) -> DataFrame:
    return t.usage.filter(clock.on_dates(F.col("usage_date"), days))


def _valued(t: Tables, usage: DataFrame, keys: list[str]) -> DataFrame:
    """Quantity and cost at current prices per ``keys``, SKU and cloud."""
    by_sku = list(dict.fromkeys([*keys, *SKU_KEY]))
    amounts = usage.groupBy(*by_sku).agg(F.sum("usage_quantity").alias("dbus"))
    # Amounts of one SKU are far fewer than usage rows; a sum keeps every digit of the quantity.
    return with_current_price(t, amounts).withColumn(
        "cost", F.col("dbus").cast("decimal(27,6)") * F.coalesce("unit_price", F.lit(0).cast("decimal(10,4)"))
    )


def _top_with_runs(top: DataFrame, usage: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``runs``, the distinct runs of each reported key.

    ``top`` is a short list whose keys all occur in ``usage``; its columns travel with the runs, so it is
    computed once.
    """
    renamed = top.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return (
        usage.select(*keys, "job_run_id")
        .join(F.broadcast(renamed), same)
        .groupBy(*keys, *(c for c in top.columns if c not in keys))
        .agg(F.countDistinct("job_run_id").alias("runs"))
    )


def costs_summary(t: Tables, clock: Clock, days: int = 30) -> DataFrame:
    """Total cost and usage, distinct jobs and runs, and averages, one row."""
    check_range("days", days, 1, 90)
    usage = recent_usage(t, clock, days)
    money = _valued(t, usage, []).agg(F.sum("cost").alias("cost"), F.sum("dbus").alias("dbus"))
    counts = usage.agg(F.countDistinct("job_id").alias("jobs"), F.countDistinct("job_run_id").alias("runs"))
    both = money.unionByName(counts, allowMissingColumns=True).agg(
        *(F.max(c).alias(c) for c in ("cost", "dbus", "jobs", "runs"))
    )
    cost = F.coalesce(F.col("cost").cast("double"), F.lit(0.0))
    return both.select(
        usd(F.col("cost")).alias("total_cost_usd"),
        usd(F.col("dbus")).alias("total_dbus"),
        F.col("jobs").alias("unique_jobs"),
        F.col("runs").alias("total_runs"),
        F.when(F.col("runs") > 0, F.round(cost / F.col("runs"), 4)).otherwise(F.lit(0.0)).alias("avg_cost_per_run"),
        F.round(cost / days, 2).alias("avg_daily_cost"),
    )


def costs_daily(t: Tables, clock: Clock, days: int = 30) -> DataFrame:
    """Cost, usage and distinct runs per day."""
    check_range("days", days, 1, 90)
    usage = recent_usage(t, clock, days)
    money = _valued(t, usage, ["usage_date"]).select("usage_date", "cost", "dbus")
    runs = usage.groupBy("usage_date").agg(F.countDistinct("job_run_id").alias("runs"))
    return (
        money.unionByName(runs, allowMissingColumns=True)
        .groupBy(F.col("usage_date").alias("date"))
        .agg(usd(F.sum("cost")).alias("cost"), usd(F.sum("dbus")).alias("dbus"), F.coalesce(F.sum("runs"), F.lit(0)).alias("job_runs"))
        .orderBy("date")
    )


def costs_top_jobs(t: Tables, clock: Clock, days: int = 30, limit: int = 10, base_url: str = "https://localhost") -> DataFrame:
    """Most expensive jobs per workspace and cloud, with their costliest SKU."""
    check_range("days", days, 1, 90)
    check_range("limit", limit, 1, 50)
    keys = ["job_id", "workspace_id", "cloud"]
    usage = recent_usage(t, clock, days).filter(F.col("job_id").isNotNull())
    labels = usage.groupBy(*keys, "sku_name").agg(
        F.sum("usage_quantity").alias("dbus"), F.min("job_name").alias("job_name"), F.min("notebook_path").alias("notebook_path")
    )
    priced = with_current_price(t, labels).withColumn(
        "cost", F.col("dbus").cast("decimal(27,6)") * F.coalesce("unit_price", F.lit(0).cast("decimal(10,4)"))
    )
    top = (
        priced.groupBy(*keys)
        .agg(
            F.min("job_name").alias("job_name"),
            F.min("notebook_path").alias("notebook_path"),
            F.sum("cost").alias("cost"),
            F.sum("dbus").alias("dbus"),
            # Costliest SKU; the lowest name among equals.
            F.min_by("sku_name", F.struct(-F.col("cost"), F.col("sku_name"))).alias("primary_sku"),
        )
        .orderBy(F.desc("cost"), *keys)
        .limit(limit)
    )
    label = F.coalesce(F.nullif("job_name", F.lit("")), F.concat(F.lit("Job "), "job_id"))
    return _top_with_runs(top, usage, keys).select(
        "job_id",
        "workspace_id",
        label.alias("job_name"),
        "notebook_path",
        usd(F.col("cost")).alias("total_cost"),
        usd(F.col("dbus")).alias("total_dbus"),
        F.col("runs").alias("run_count"),
        F.round(F.col("cost").cast("double") / F.greatest("runs", F.lit(1)), 4).alias("avg_cost_per_run"),
        "primary_sku",
        "cloud",
        F.concat(F.lit(f"{base_url.rstrip('/')}/jobs/"), "job_id").alias("job_url"),
    ).orderBy(F.desc("total_cost"), *keys)


def costs_by_identity(t: Tables, clock: Clock, days: int = 30, limit: int = 20) -> DataFrame:
    """Flat-rate cost of serverless usage per identity; NULL is labelled after grouping."""
    check_range("days", days, 1, 90)
    check_range("limit", limit, 1, 100)
    usage = recent_usage(t, clock, days).filter("is_serverless")
    top = (
        usage.groupBy("run_as")
        .agg(F.sum("usage_quantity").alias("dbus"))
        .orderBy(F.desc("dbus"), "run_as")
        .limit(limit)
    )
    return _top_with_runs(top, usage, ["run_as"]).select(
        F.coalesce("run_as", F.lit(V.UNKNOWN_IDENTITY)).alias("identity"),
        usd(F.col("dbus").cast("decimal(27,6)") * flat_price()).alias("total_cost"),
        usd(F.col("dbus")).alias("total_dbus"),
        F.col("runs").alias("job_runs"),
    ).orderBy(F.desc("total_cost"), "identity")


def costs_by_sku(t: Tables, clock: Clock, days: int = 30, limit: int = 20) -> DataFrame:
    """Cost per SKU, cloud and unit price with category and distinct jobs and workspaces."""
    check_range("days", days, 1, 90)
    check_range("limit", limit, 1, 50)
    amounts = recent_usage(t, clock, days).groupBy(*SKU_KEY).agg(
        F.sum("usage_quantity").alias("dbus"),
        F.countDistinct("job_id").alias("job_count"),
        F.countDistinct("workspace_id").alias("workspace_count"),
    )
    price = F.coalesce("unit_price", F.lit(0).cast("decimal(10,4)"))
    return (
        with_current_price(t, amounts)
        .withColumn("cost", F.col("dbus").cast("decimal(27,6)") * price)
        .orderBy(F.desc("cost"), *SKU_KEY)
        .limit(limit)
        .select(
            "sku_name",
            "cloud",
            sku_category(F.col("sku_name")).alias("category"),
            usd(price, 4).alias("unit_price"),
            usd(F.col("dbus")).alias("total_dbus"),
            usd(F.col("cost")).alias("total_cost"),
            "job_count",
            "workspace_count",
        )
    )


def costs_trends_flat(t: Tables, clock: Clock, weeks: int = 8) -> DataFrame:
    """Weekly flat-rate cost of serverless usage, for installations without a tag log."""
    check_range("weeks", weeks, 1, 52)
    return (
        recent_usage(t, clock, weeks * 7)
        .filter("is_serverless")
        .groupBy(F.trunc("usage_date", "week").alias("week_start"))
        .agg(F.sum("usage_quantity").alias("q"), F.countDistinct("job_run_id").alias("job_runs"))
        .select(
            "week_start",
            usd(F.col("q").cast("decimal(27,6)") * flat_price()).alias("cost"),
            usd(F.col("q")).alias("dbus"),
            "job_runs",
        )
        .orderBy("week_start")
    )


def sku_labels(t: Tables, clock: Clock, days: int = 90) -> DataFrame:
    """Category and short label of every SKU in use."""
    return (
        recent_usage(t, clock, days)
        .groupBy("sku_name")
        .agg(F.count("*").alias("usage_rows"))
        .withColumn("category", sku_category(F.col("sku_name")))
        .withColumn("short_label", sku_short_label(F.col("sku_name")))
    )


# Reports over usage joined with the tag log. Their rows are attributed usage; the ``named`` functions take its totals per group.


def _per_run(rows: DataFrame) -> DataFrame:
    """Cost and usage of each run per date and six tag dimensions, added up before anything is counted."""
    return rows.groupBy(*SUMMARY_KEYS, "job_run_id").agg(F.sum("estimated_cost_usd").alias("c"), F.sum("dbus").alias("q"))


def _totals():
    """A run counts once in each group of the summary for ``job_runs``, and once altogether for ``job_runs_distinct``."""
    return [
        F.sum("c").alias("c"),
        F.sum("q").alias("q"),
        F.count("job_run_id").alias("job_runs"),
        F.countDistinct("job_run_id").alias("job_runs_distinct"),
    ]


def roll_up_projects(rows: DataFrame) -> DataFrame:
    """Cost and runs per project and department."""
    return named_projects(_per_run(rows).groupBy("project_code", "department").agg(*_totals()))


def named_projects(totals: DataFrame) -> DataFrame:
    return (
        totals.select(
            F.coalesce("project_code", F.lit(V.UNTAGGED_PROJECT)).alias("project_code"),
            F.coalesce("department", F.lit(V.UNKNOWN_DEPARTMENT)).alias("department"),
            usd(F.col("c")).alias("total_cost"),
            usd(F.col("q")).alias("total_dbus"),
            "job_runs",
            "job_runs_distinct",
        )
        .orderBy(F.desc("total_cost"), "project_code", "department")
    )


def roll_up_departments(rows: DataFrame) -> DataFrame:
    """Cost and runs per department with the number of its projects."""
    # First per project and run, so that only one distinct count is left for each step.
    per_project = _per_run(rows).groupBy("department", "project_code", "job_run_id").agg(F.sum("c").alias("c"), F.sum("q").alias("q"), F.count("*").alias("n"))
    return named_departments(
        per_project.groupBy("department").agg(
            F.sum("c").alias("c"),
            F.sum("q").alias("q"),
            F.coalesce(F.sum(F.when(F.col("job_run_id").isNotNull(), F.col("n"))), F.lit(0)).alias("job_runs"),
            F.countDistinct("job_run_id").alias("job_runs_distinct"),
            F.countDistinct("project_code").alias("project_count"),
        )
    )


def named_departments(totals: DataFrame) -> DataFrame:
    return (
        totals.select(
            F.coalesce("department", F.lit(V.UNKNOWN_DEPARTMENT)).alias("department"),
            usd(F.col("c")).alias("total_cost"),
            usd(F.col("q")).alias("total_dbus"),
            "job_runs",
            "job_runs_distinct",
            "project_count",
        )
        .orderBy(F.desc("total_cost"), "department")
    )


def roll_up_weeks(trends: DataFrame, clock: Clock, weeks: int = 8) -> DataFrame:
    """Weekly totals and the change against the previous shown week, computed on the rounded cost."""
    check_range("weeks", weeks, 1, 52)
    weekly = (
        trends.filter(F.col("week_start") >= F.lit(clock.today - timedelta(weeks=weeks)))
        .groupBy("week_start")
        .agg(
            usd(F.sum("weekly_cost_usd")).alias("cost"),
            usd(F.sum("weekly_dbus")).alias("dbus"),
            F.sum("weekly_job_runs").alias("job_runs"),
        )
    )
    previous = F.lag("cost").over(Window.orderBy("week_start"))  # at most 53 rows
    change = F.when(F.col("_prev") > 0, F.round((F.col("cost") - F.col("_prev")) / F.col("_prev") * 100, 2))
    return (
        weekly.withColumn("_prev", previous)
        .withColumn("wow_change_pct", F.when(F.col("_prev").isNotNull(), F.coalesce(change, F.lit(0.0))))
        .drop("_prev")
        .orderBy("week_start")
    )

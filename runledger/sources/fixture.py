"""The six inputs derived from the generic test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import schemas
from runledger.clock import Clock
from runledger.sources import fixture_sql
from runledger.sources.tables import Tables, seed_policies

CLOCK = Clock(datetime(2024, 1, 31))


def _derive(spark: SparkSession, sql: str, sf_dir: str, *names: str, frames: dict[str, DataFrame] | None = None) -> DataFrame:
    for name in names:
        sql = sql.replace(f"FROM {name}", "FROM {%s}" % name).replace(f"JOIN {name}", "JOIN {%s}" % name)
    sql = sql.replace("{ts}", "TIMESTAMP_NTZ")
    frames = frames or {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in names}
    return spark.sql(sql, **frames)


def load(spark: SparkSession, sf_dir: str) -> Tables:
    derive = lambda sql, *names: lambda: _derive(spark, sql, sf_dir, *names)
    return Tables(
        runs=derive(fixture_sql.RUNS, "events"),
        jobs=derive(fixture_sql.JOBS, "customer"),
        usage=derive(fixture_sql.USAGE, "lineitem"),
        list_prices=derive(fixture_sql.LIST_PRICES),
        tags=derive(fixture_sql.TAGS, "orders", "customer"),
        policies=lambda: seed_policies(spark),
    )


def tag_events(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Start and end events that a tag log like ``tags`` would come from, on a batch or a stream.

    Some starts name no environment, and half of them carry a custom tag.
    """
    named = ["adf_pipeline_name", "adf_run_id", "project_code", "cost_center", "department", "business_unit", "application_name", "owner_email"]
    key = F.col("correlation_id")
    team = F.when(key % 2 == 0, F.concat(F.lit("team-"), (key % 7).cast("string"))).otherwise(F.lit(""))
    environment = F.when(key % 3 != 0, F.struct(F.lit("environment").alias("key"), F.col("environment").alias("value")))
    entries = F.array(
        *(F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in named),
        F.struct(F.lit("team").alias("key"), team.alias("value")),
        environment,
    )
    given = {
        "job_run_id": F.col("job_run_id"),
        "notebook_path": F.col("notebook_path"),
        "created_by": F.col("created_by"),
        "start_time": F.col("run_start_time"),
        "tags": F.map_from_entries(F.array_compact(entries)),
    }
    starts = tags.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TAG_STARTS))
    ends = tags.filter(F.col("run_end_time").isNotNull()).select(
        "job_run_id", F.col("run_end_time").alias("end_time"), F.col("run_status").alias("status")
    )
    return starts, ends


def later_and_stray_ends(tags: DataFrame) -> DataFrame:
    """The end events of a tag log, each repeated later, and ends that precede their run."""
    _, ends = tag_events(tags)
    again = ends.select("job_run_id", (F.col("end_time") + F.expr("INTERVAL 90 MINUTES")).alias("end_time"), F.lit("CANCELLED").alias("status"))
    stray = tags.select(
        "job_run_id", (F.col("run_start_time") - F.expr("INTERVAL 5 MINUTES")).alias("end_time"), F.lit("SKIPPED").alias("status")
    )
    return ends.unionByName(again).unionByName(stray)


def tags_as_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag log derived from a stream of orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    frames = {
        # A pattern, as a stream's plain path must be a folder.
        "orders": spark.readStream.schema(orders).parquet(f"{sf_dir}/orders*.parquet"),
        "customer": spark.read.parquet(f"{sf_dir}/customer.parquet"),
    }
    return _derive(spark, fixture_sql.TAGS, sf_dir, "orders", "customer", frames=frames)

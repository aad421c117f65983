"""Cases in which a list's limit, a fixed set of columns or a missing value once changed a result."""

from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from data import CLOCK, frame, job, price, run, tables, tag, usage
from runledger import schemas
from runledger.operators import health, jobs, pricing, tags
from runledger.operators.skew import hot_keys, spread_join
from runledger.plans import reports


def policy(key, required=True, **more):
    return dict(tag_key=key, is_required=required, is_active=True, **more)


def test_score_counts_all_jobs(spark):
    runs = []
    for j in range(120):
        lengths = [10] * 8 if j < 60 else [1] * 7 + [100]
        runs += [run(1000 * j + i, f"29 {i:02}:00", f"29 {i:02}:01", job=j, duration=d) for i, d in enumerate(lengths)]
        runs.append(run(1000 * j + 99, "29 20:00", "29 20:01", state="FAILED", job=j))
    t = tables(spark, runs=runs, jobs=[job(j, f"job {j}") for j in range(120)])
    row = health.health_score(t, CLOCK).first()
    assert (row.health_score, row.sla_jobs, row.failed_jobs) == (50, 120, 120)
    assert health.health_failed_jobs(t, CLOCK, limit=10).count() == 10


def test_trends_over_a_year(spark):
    monday = date(2024, 1, 29)
    rows = [usage((monday - timedelta(weeks=w)).isoformat(), qty=1 + w) for w in range(50)]
    t = tables(spark, usage=rows)
    assert reports.costs_trends(t, CLOCK, weeks=52).count() == 50
    short = reports.attribute_usage(t, CLOCK, 90)
    with pytest.raises(ValueError, match="holds 90 days"):
        reports.costs_trends(t, CLOCK, weeks=52, attributed=short)
    assert reports.costs_trends(t, CLOCK, weeks=8, attributed=short).count() == reports.costs_trends(t, CLOCK, weeks=8).count()


def test_stored_rows_know_their_window(spark, tmp_path):
    t = tables(spark, usage=[usage("2024-01-29")])
    stored = reports.materialize(t, CLOCK, str(tmp_path / "attributed"), days=30)
    with pytest.raises(ValueError):
        reports.costs_by_project(t, CLOCK, days=60, attributed=stored)
    assert reports.costs_by_project(t, CLOCK, days=30, attributed=stored).count() == 1


def test_timeline_shows_the_rows_asked_for(spark):
    runs = [run(i, f"30 {i // 60:02}:{i % 60:02}", f"30 {i // 60:02}:{i % 60:02}") for i in range(400)]
    assert jobs.jobs_timeline(tables(spark, runs=runs), CLOCK, rows=300).count() == 300


def test_policies_on_any_tag(spark):
    t = tables(spark, tags=[tag(1), tag(2, adf_pipeline_name="p", custom_tags={"team": "a"}), tag(3, custom_tags={"team": "b1"})])
    given = [policy("team", validation_regex="^[a-z]$"), policy("adf_pipeline_name"), policy("unknown", required=False)]
    t = t.replace(policies=frame(spark, schemas.TAG_POLICY, given))
    found = {(r.correlation_id, r.tag_key, r.rule) for r in tags.tags_validate(t).collect()}
    assert found == {(1, "team", "missing"), (1, "adf_pipeline_name", "missing"), (3, "team", "pattern"), (3, "adf_pipeline_name", "missing")}
    assert {r.correlation_id: (r.errors, r.is_valid) for r in tags.tags_validity(t).collect()} == {1: (2, False), 2: (0, True), 3: (2, False)}
    assert {r.tag_key for r in tags.tags_validate(t, fields=["team"]).collect()} == {"team"}


def test_validation_without_a_policy_table(spark):
    t = tables(spark, tags=[tag(1)]).replace(policies=None)
    assert tags.tags_validity(t).first().errors == tags.tags_required(t, spark).count()


def test_price_without_a_cloud(spark):
    t = tables(spark, usage=[usage("2024-01-29", sku="S")], prices=[price("S", None, "0.50")])
    assert pricing.price_usage(t, CLOCK, "asof").first().unit_price == Decimal("0.5000")
    both = t.replace(list_prices=frame(spark, schemas.LIST_PRICES, [price("S", None, "0.50"), price("S", "AWS", "0.20"), price("S", "GCP", "0.30")]))
    assert pricing.price_usage(both, CLOCK, "asof").first().unit_price == Decimal("0.2000")


def test_matrix_ids_that_are_no_numbers(spark):
    runs = [run(i, "29 10:00", "29 10:01", job=j) for i, j in enumerate(["x", "y", "5"])] + [{**run(9, "29 10:00", "29 10:01"), "job_id": None}]
    t = tables(spark, runs=runs, jobs=[job("x", "X"), job("y", "Y"), job("5", "Five")])
    grid = jobs.jobs_matrix(t, CLOCK).collect()
    assert [(r.job_id, r.job_name, len(r.runs)) for r in grid] == [(None, "X", 1), (None, "Y", 1), (5, "Five", 1)]
    assert jobs.jobs_matrix(t, CLOCK, limit=2).count() == 2


def test_distinct_runs_of_reports(spark):
    """A run on two days counts twice over the daily groups, once altogether."""
    rows = [usage(d, run_id="1") for d in ("2024-01-28", "2024-01-29")] + [usage("2024-01-29", run_id="2"), usage("2024-01-29")]
    t = tables(spark, usage=rows, tags=[tag(1, run_id="1", project_code="P", department="D"), tag(2, run_id="2", project_code="Q", department="D")])
    shown = {r.department: (r.job_runs, r.job_runs_distinct, r.project_count) for r in reports.costs_by_department(t, CLOCK).collect()}
    assert shown == {"D": (3, 2, 2), "Unknown": (0, 0, 0)}
    assert {r.project_code: (r.job_runs, r.job_runs_distinct) for r in reports.costs_by_project(t, CLOCK).collect()} == {"P": (2, 1), "Q": (1, 1), "Untagged": (0, 0)}


def test_a_hot_key_in_one_input_partition_is_spread(spark):
    left = spark.range(0, 2000).select(F.when(F.col("id") % 4 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("l"))
    left = left.repartition(4, "k")
    right = left.select("k").distinct().withColumn("r", F.lit(1))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_join(left, right, ["k"], "inner", hot_left=hot_keys(left, ["k"], partitions=8))
        assert joined.filter("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count() > 1
        assert joined.count() == 2000
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_share_reads_its_input_once(spark):
    t = tables(spark, usage=[usage("2024-01-29")])
    departments = reports.costs_by_department(t, CLOCK)
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation") + df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
    assert scans(jobs.share_of(departments, "total_cost")) == scans(departments)

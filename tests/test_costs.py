import random
from collections import Counter
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from data import CLOCK, NOW, job, price, tables, tag, usage
from runledger import schemas
from runledger.functions import sku_category, sku_short_label
from runledger.operators import costs, pricing
from runledger.operators.attribution import attribute_usage, attribution_totals, unmatched_rows
from runledger.plans import reports, views
from runledger.sources.tables import flatten_prices, flatten_usage, read_tables
from pyspark.sql import functions as F


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_summary_of_nothing_is_zeros(spark):
    assert rows(costs.costs_summary(tables(spark), CLOCK)) == [(0.0, 0.0, 0, 0, 0.0, 0.0)]


PRICES = [
    price("S", "AWS", "0.10", end="2023-12-15 00:00:00"),
    price("S", "AWS", "0.20", start="2023-12-15 00:00:00"),
    price("S", "GCP", "0.90"),
    price("ONLY_GCP", "GCP", "0.50"),
    price("ONLY_GCP", "AZURE", "0.50", end="2024-01-20 00:00:00"),
]


def unit_prices(spark, mode, used, bound=200_000):
    t = tables(spark, usage=used, prices=PRICES, broadcast_rows=bound)
    return {(r.usage_date.isoformat(), r.sku_name, r.cloud): str(r.unit_price) for r in pricing.price_usage(t, CLOCK, mode).collect()}


@pytest.mark.parametrize("bound", [200_000, 0])
def test_price_changes_on_its_start_date(spark, bound):
    used = [usage(d, sku=s, cloud=c) for d in ("2023-12-14", "2023-12-15") for s, c in (("S", "AWS"), ("ONLY_GCP", "AWS"), ("NONE", "AWS"))]
    got = unit_prices(spark, "asof", used, bound)
    assert got["2023-12-14", "S", "AWS"] == "0.1000" and got["2023-12-15", "S", "AWS"] == "0.2000"
    assert got["2023-12-15", "ONLY_GCP", "AWS"] == "0.5000"
    assert got["2023-12-15", "NONE", "AWS"] == "0.1500"
    current = unit_prices(spark, "current", used, bound)
    assert current["2023-12-14", "S", "AWS"] == "0.2000" and current["2023-12-15", "ONLY_GCP", "AWS"] == "0.0000"
    assert set(unit_prices(spark, "flat", used, bound).values()) == {"0.1500"}


def test_repeated_current_price_is_rejected(spark):
    with pytest.raises(ValueError, match="list prices"):
        tables(spark, prices=[price("S", "AWS", "1"), price("S", "AWS", "2")]).checked()
    with pytest.raises(ValueError, match="jobs"):
        tables(spark, jobs=[job(1, "a"), job(1, "b")]).checked()
    fixed = tables(spark, jobs=[job(1, "a", deleted=NOW), job(1, "b")]).with_latest_definitions().checked()
    assert [r.name for r in fixed.jobs.collect()] == ["b"]


def test_top_jobs_labels(spark):
    used = [usage("2024-01-30", qty=q, sku=s, run_id=r) for q, s, r in ((1, "S", "1"), (5, "ONLY_GCP", "2"), (1, "S", "2"))]
    used.append(usage("2024-01-30", run_id="9", job_id="2", job_name=None))
    used.append(usage("2024-01-30", run_id="9", job_id=None))
    got = costs.costs_top_jobs(tables(spark, usage=used, prices=PRICES), CLOCK, base_url="https://host/").collect()
    assert [(r.job_id, r.job_name, r.total_cost, r.run_count, r.primary_sku, r.job_url) for r in got] == [
        ("1", "one", 0.4, 2, "S", "https://host/jobs/1"),
        ("2", "Job 2", 0.0, 1, "JOBS_COMPUTE", "https://host/jobs/2"),
    ]


def test_null_identity_stays_apart_from_its_label(spark):
    used = [usage("2024-01-30", qty=q, run_as=r) for q, r in ((3, None), (2, "Unknown"))]
    assert [(r.identity, r.total_dbus) for r in costs.costs_by_identity(tables(spark, usage=used), CLOCK).collect()] == [("Unknown", 3.0), ("Unknown", 2.0)]


def test_every_sku_rule(spark):
    expected = {
        "SERVERLESS_SQL": "Serverless SQL",
        "jobs_serverless": "Serverless Jobs",
        "ALL_PURPOSE_SERVERLESS": "Serverless Compute",
        "DATABASE_SERVERLESS": "Serverless Database",
        "SERVERLESS_INFERENCE": "Model Serving",
        "MODEL_SERVING": "Model Serving",
        "GPU_INFERENCE": "Model Serving",
        "SQL_PRO": "SQL Pro",
        "SQL_CLASSIC": "SQL Warehouse",
        "DLT_CORE": "Delta Live Tables",
        "ALL_PURPOSE": "All-Purpose Compute",
        "JOBS": "Jobs Compute",
        "OLTP": "Lakebase/OLTP",
        "LAKEBASE": "Lakebase/OLTP",
        "DATABASE": "Lakebase/OLTP",
        "SERVERLESS": "Other",
        None: "Other",
    }
    df = spark.createDataFrame([(k,) for k in expected], "s string")
    assert {r.s: r.c for r in df.select("s", sku_category(F.col("s")).alias("c")).collect()} == expected


def test_short_labels(spark):
    expected = {"A_B_C_D": "B C", "A_B": "B", "A": "N/A", None: "N/A"}
    df = spark.createDataFrame([(k,) for k in expected], "s string")
    assert {r.s: r.c for r in df.select("s", sku_short_label(F.col("s")).alias("c")).collect()} == expected


def test_nested_sources(spark, tmp_path):
    nested = spark.createDataFrame(
        [(date(2024, 1, 30), "0", "AWS", "S", "JOBS", Decimal(2), ("1", "7", "one", "/nb"), ("me",), (True,), datetime(2024, 1, 30, 1), None)],
        schemas.USAGE_NESTED,
    )
    prices = spark.createDataFrame([("S", "AWS", (Decimal("0.5"),), datetime(2020, 1, 1), None)], schemas.LIST_PRICES_NESTED)
    assert sorted(flatten_usage(nested).columns) == sorted(schemas.USAGE.names)
    assert flatten_prices(prices).columns == schemas.LIST_PRICES.names
    nested.write.parquet(f"{tmp_path}/usage")
    prices.write.parquet(f"{tmp_path}/prices")
    t = read_tables(spark, {"usage": f"{tmp_path}/usage", "list_prices": f"{tmp_path}/prices"}, nested=True)
    summary = costs.costs_summary(t, CLOCK).collect()[0]
    assert (summary.total_cost_usd, summary.unique_jobs, summary.total_runs) == (1.0, 1, 1)


def brute_attribution(used, tags):
    pairs = Counter()
    for u in used:
        hits = [
            t["correlation_id"]
            for t in tags
            if (u["job_run_id"] is not None and u["job_run_id"] == t["job_run_id"])
            or (
                u["notebook_path"] is not None
                and u["notebook_path"] == t["notebook_path"]
                and t["run_start_time"] <= u["usage_start_time"] <= (t["run_end_time"] or NOW)
            )
        ]
        for hit in hits or [None]:
            pairs[u["job_run_id"], u["notebook_path"], u["usage_start_time"], hit] += 1
    return pairs


def attributed(t):
    return Counter((r.job_run_id, r.notebook_path, r.usage_start_time, r.correlation_id) for r in attribute_usage(t, CLOCK).collect())


def test_row_matching_both_ways_appears_once(spark):
    used = [usage("2024-01-20", run_id="5", notebook="/nb", start=datetime(2024, 1, 20, 1))]
    t = tables(spark, usage=used, tags=[tag(1, "5", "/nb", "20 00:00", "20 02:00")])
    assert list(attributed(t).values()) == [1]


def test_row_without_run_id_matches_by_notebook(spark):
    used = [usage("2024-01-20", notebook="/nb", start=datetime(2024, 1, 20, h)) for h in (0, 2, 3)]
    t = tables(spark, usage=used, tags=[tag(1, None, "/nb", "20 00:00", "20 02:00")])
    assert [k[3] for k in sorted(attributed(t), key=lambda k: k[2])] == [1, 1, None]


def random_case(seed, hot):
    rng = random.Random(seed)
    used, tags = [], []
    for i in range(240):
        day = date(2024, 1, 1) + timedelta(days=rng.randrange(30))
        run_id = rng.choice([None, "hot" if hot else str(rng.randrange(60)), str(rng.randrange(60))])
        notebook = rng.choice([None, "/nb0" if hot else f"/nb{rng.randrange(4)}", f"/nb{rng.randrange(4)}"])
        start = datetime(day.year, day.month, day.day) + timedelta(hours=rng.randrange(-30 if rng.random() < 0.05 else 0, 24))
        used.append(usage(day.isoformat(), run_id=run_id, notebook=notebook, start=start))
        if rng.random() < 0.1:
            used.append(dict(used[-1]))
    for i in range(80):
        start = datetime(2023, 12, 20) + timedelta(hours=rng.randrange(40 * 24))
        end = rng.choice([None, start, start + timedelta(hours=rng.randrange(1, 100)), start - timedelta(hours=1)])
        made = tag(i, rng.choice([None, "hot" if hot and i < 3 else str(rng.randrange(80))]), rng.choice([None, f"/nb{rng.randrange(4)}"]))
        made.update(run_start_time=start, run_end_time=end)
        tags.append(made)
    return used, tags


@pytest.mark.parametrize("seed,hot,partitions", [(1, False, 8), (2, True, 8), (3, True, 40)])
def test_attribution_equals_brute_force(spark, seed, hot, partitions):
    used, tags = random_case(seed, hot)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        t = tables(spark, usage=used, tags=tags)
        t = t.replace(usage=t.usage.repartition(6), tags=t.tags.repartition(5))
        want = brute_attribution(used, tags)
        assert attributed(t) == want
        unmatched = Counter((r.job_run_id, r.notebook_path, r.usage_start_time, None) for r in unmatched_rows(t, CLOCK).collect())
        assert unmatched == Counter({k: n for k, n in want.items() if k[3] is None})
        # Every test row costs 0.15.
        matched = sum(n for k, n in want.items() if k[3] is not None)
        alone = sum(unmatched.values())
        assert {r.correlation_status: (r.n, float(r.c)) for r in attribution_totals(t, CLOCK).collect()} == {
            "MATCHED": (matched, pytest.approx(0.15 * matched)),
            "UNMATCHED": (alone, pytest.approx(0.15 * alone)),
        }
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_attribution_of_nothing(spark):
    t = tables(spark)
    assert attribute_usage(t, CLOCK).count() == 0 and attribution_totals(t, CLOCK).count() == 0
    assert rows(reports.correlation_rate(t, CLOCK)) == [(0, 0, 0, 0.0)]
    assert rows(reports.costs_untagged_pct(t, CLOCK)) == [(0.0, 0.0, 0.0)]


def test_previous_week_is_the_previous_active_week(spark):
    used = [usage(d, qty=q, run_id="1") for d, q in (("2024-01-02", 10), ("2024-01-17", 15))]
    t = tables(spark, usage=used, tags=[tag(1, "1", project_code="P", department="D")])
    got = sorted(rows(views.cost_trends_wow(t, CLOCK).select("week_start", "prev_week_cost", "wow_change_pct")))
    assert got == [(date(2024, 1, 1), None, None), (date(2024, 1, 15), Decimal("1.5000000000"), 50.0)]


def test_reports_agree_and_can_share_a_stored_attribution(spark, tmp_path):
    used, tags = random_case(7, False)
    for i, t in enumerate(tags):
        t.update(project_code=f"P{i % 3}" if i % 4 else None, department=f"D{i % 2}", adf_pipeline_name=f"pl{i % 3}")
    t = tables(spark, usage=used, tags=tags)
    stored = reports.materialize(t, CLOCK, f"{tmp_path}/attributed")
    for build in (reports.costs_by_project, reports.correlation_breakdown, reports.tags_unmatched):
        assert sorted(rows(build(t, CLOCK, attributed=stored)), key=str) == sorted(rows(build(t, CLOCK)), key=str), build.__name__
    rate = reports.correlation_rate(t, CLOCK, attributed=stored).collect()[0]
    assert rate.total_records == rate.matched + rate.unmatched
    total = lambda df: round(sum(r.total_cost for r in df.collect()), 1)
    by_project = total(reports.costs_by_project(t, CLOCK, attributed=stored))
    assert by_project == pytest.approx(total(reports.costs_by_department(t, CLOCK, attributed=stored)), abs=0.2)


def test_views_can_be_queried_with_sql(spark):
    t = tables(spark, usage=[usage("2024-01-20", run_id="1")], tags=[tag(1, "1")])
    names = views.register_views(t, CLOCK, prefix="rl_")
    assert len(names) == 5
    assert rows(spark.sql("SELECT correlation_status, count(*) FROM rl_cost_by_tags GROUP BY 1")) == [("MATCHED", 1)]
    for name in names:
        spark.sql(f"SELECT count(*) FROM {name}").collect()
        spark.catalog.dropTempView(name)

"""Totals per group that no row per run, notebook and dimension is built for, against the attributed rows themselves."""

from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from data import CLOCK, at, tables, tag, usage
from runledger.operators import factorised
from runledger.operators.attribution import attribute_usage
from runledger.operators.factorised import attributed_totals
from runledger.plans import reports, views
from test_costs import random_case

BY_DAY, BY_WEEK = lambda day: day, lambda day: F.trunc(day, "week")
SUMS = ["q", "n", "c", "most", "yes", "no", "runs", "notebooks"]


def listed(rows, keys):
    picked = rows.select(*keys, *(F.col(c).cast("double") for c in SUMS))
    return Counter(tuple(r) for r in picked.collect())


def of_pairs(t, keys, period):
    rows = attribute_usage(t, CLOCK)
    matched = F.col("correlation_status") == "MATCHED"
    by = [*([period(F.col("usage_date")).alias("_period")] if period else []), *keys]
    return rows.groupBy(*by).agg(
        F.sum("dbus").alias("q"), F.count("dbus").alias("n"), F.sum("estimated_cost_usd").alias("c"), F.max("estimated_cost_usd").alias("most"),
        F.count_if(matched).alias("yes"), F.count_if(~matched).alias("no"), F.countDistinct("job_run_id").alias("runs"), F.countDistinct("notebook_path").alias("notebooks"),
    )


def case(spark, seed, hot, **more):
    used, tags = random_case(seed, hot)
    for i, record in enumerate(tags):
        record.update(project_code=None if i % 5 == 0 else f"P{i % 2}", department=None if i % 3 else "D")
    # Runs in several cells of a day, some of which have a record, and records without any tag or of a time without usage.
    hours = [at(f"20 {h:02}:00") for h in (3, 9, 15)]
    used += [usage("2024-01-20", run_id=f"m{i}", notebook=f"/nb{i % 2}", start=h) for i in range(12) for h in hours[: 1 + i % 3]]
    used += [usage("2024-01-20", run_id=f"m{i}") for i in range(0, 12, 4)]
    tags += [tag(800 + i, f"m{i}", f"/nb{i % 3}", f"20 0{i % 9}:00", "20 12:00", project_code="P0" if i % 2 else None) for i in range(5)]
    tags += [tag(900 + i, None, "/nb1", "10 00:00", f"10 0{i % 6}:30", project_code="P0") for i in range(20)] + [dict(x) for x in tags[:5]]
    return tables(spark, usage=used, tags=tags, **more)


@pytest.mark.parametrize("keys,period", [(factorised.DIMENSIONS, BY_DAY), (["project_code", "department"], BY_WEEK), (["department"], None)])
@pytest.mark.parametrize("seed,hot", [(1, False), (2, True)])
def test_groups_equal_those_of_the_pairs(spark, keys, period, seed, hot):
    t = case(spark, seed, hot)
    got = attributed_totals(t, CLOCK).grouped(keys, period, notebooks=True)
    named = [*(["_period"] if period else []), *keys]
    assert listed(got, named) == listed(of_pairs(t, keys, period), named)


def test_many_groups_and_nothing_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(factorised, "_FEW_GROUPS", 1)
    t, keys = case(spark, 3, False, broadcast_rows=1), ["project_code", "department"]
    assert listed(attributed_totals(t, CLOCK).grouped(keys, BY_WEEK, notebooks=True), ["_period", *keys]) == listed(of_pairs(t, keys, BY_WEEK), ["_period", *keys])


def test_runs_of_the_same_cells_are_counted_not_listed(spark):
    """300 runs in the same two cells meet 70 dimensions in 140 rows; a row per run and dimension would be 21,000."""
    hours = [at("20 10:00"), at("20 13:00")]
    used = [usage("2024-01-20", notebook="/nb", start=h, run_id=str(i)) for i in range(300) for h in hours]
    tags = [{**tag(i, None, "/nb", project_code=f"P{i}"), "run_start_time": hours[0] - timedelta(hours=1), "run_end_time": hours[1]} for i in range(70)]
    t = tables(spark, usage=used, tags=tags)
    totals = attributed_totals(t, CLOCK)
    group = factorised._Group(totals, factorised.DIMENSIONS, BY_DAY)
    assert (totals.cells.count(), totals.live.count(), group._cell_sets.count()) == (2, 140, 2)
    assert group.by_notebook(True).count() == 140 and group.runs_of_several_cells().count() == 70
    assert {(r.job_runs, r.unique_notebooks, r.matched_runs) for r in views.cost_summary(t, CLOCK).collect()} == {(300, 1, 600)}
    row = reports.costs_by_department(t, CLOCK).first()
    assert (row.job_runs, row.job_runs_distinct, row.project_count) == (21_000, 300, 70)
    assert {(r.job_runs, r.job_runs_distinct) for r in reports.costs_by_project(t, CLOCK).collect()} == {(300, 300)}
    assert reports.costs_trends(t, CLOCK, weeks=52).first().job_runs == 21_000
    assert reports.costs_by_pipeline(t, CLOCK).first().job_runs == 300


def test_a_long_record_is_a_few_nodes(spark):
    """A record of a month is cut into bounds and nodes of the time tree, not into a row for every six hours."""
    used = [usage(f"2024-01-{d:02}", notebook="/nb", run_id=str(d)) for d in range(2, 31)]
    t = tables(spark, usage=used, tags=[tag(1, None, "/nb", "01 01:00", None, project_code="P")])
    totals = attributed_totals(t, CLOCK)
    assert factorised._segments(totals.tags, totals.profile).count() < 70 and totals.live.count() == 29

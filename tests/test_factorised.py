"""Totals without pairs against the attributed rows themselves."""

from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from data import CLOCK, at, tables, tag, usage
from runledger.operators.attribution import attribute_usage, unmatched_rows
from runledger.operators.factorised import attributed_totals, totals_of
from runledger.plans import reports, views
from test_costs import random_case


def rows_of(totals):
    named = totals.named(totals.narrow())
    return Counter(tuple(r) for r in named.select(*sorted(named.columns)).withColumns({c: F.col(c).cast("double") for c in ("q", "c", "most")}).collect())


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True)])
def test_totals_equal_those_of_the_pairs(spark, seed, hot):
    used, tags = random_case(seed, hot)
    for i, record in enumerate(tags):
        record.update(project_code=f"P{i % 2}", department=None if i % 3 else "D")
    # Records that repeat, and many of one dimension that overlap in one bucket.
    tags += [dict(x) for x in tags[:10]] + [tag(900 + i, None, "/nb1", "10 00:00", f"10 0{i % 6}:30", project_code="P0") for i in range(60)]
    t = tables(spark, usage=used, tags=tags)
    given = totals_of(attribute_usage(t, CLOCK), F.col("correlation_status") == "MATCHED")
    assert rows_of(attributed_totals(t, CLOCK)) == rows_of(given)


def test_ends_and_bucket_borders_count(spark):
    """A record runs at both of its ends, also on the border of two buckets."""
    hours = ["2024-01-20 05:59:59.999999", "20 06:00:00", "20 12:00:00", "2024-01-20 12:00:00.000001", "20 18:00:00"]
    used = [usage("2024-01-20", notebook="/nb", start=at(h)) for h in hours]
    tags = [tag(1, None, "/nb", "20 06:00:00", "20 12:00:00"), tag(2, None, "/nb", "20 12:00:00", "20 12:00:00"), tag(3, None, "/nb", "20 17:00:00", "20 16:00:00")]
    summary = views.cost_summary(tables(spark, usage=used, tags=tags), CLOCK).first()
    assert (summary.matched_runs, summary.unmatched_runs) == (3, 3)


def test_nothing(spark):
    t = tables(spark)
    assert views.cost_summary(t, CLOCK).collect() == [] and reports.costs_by_department(t, CLOCK).collect() == []


def test_no_pair_of_usage_and_record(spark):
    """A hundred records of one dimension that run together meet a usage instant once."""
    used = [usage("2024-01-20", notebook="/nb", start=at("20 10:00"), run_id=str(i)) for i in range(40)]
    tags = [tag(i, f"t{i}", "/nb", "20 01:00", "20 23:00", project_code="P") for i in range(100)]
    t = tables(spark, usage=used, tags=tags)
    totals = attributed_totals(t, CLOCK)
    assert totals.narrow().count() == 40 and totals.narrow().agg(F.sum("yes")).first()[0] == 4_000
    joins = [line for line in totals.narrow()._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert joins and all("correlation_id" not in line for line in joins)


def test_a_third_of_all_records_in_one_bucket(spark):
    """Unmatched usage between many short records of one notebook and bucket, some of which meet or hold others."""
    length = lambda m: 40 if m % 11 == 0 else 1 if m % 3 == 0 else 0
    base = at("20 06:00")
    spans = [(base + timedelta(minutes=m), base + timedelta(minutes=m + length(m), seconds=20)) for m in range(0, 200, 2)]
    tags = []
    for i, (start, end) in enumerate(spans):
        tags.append({**tag(i, None, "/nb"), "run_start_time": start, "run_end_time": end})
        tags.append(tag(1_000 + i, None, f"/nb{i}", "19 00:00", "19 01:00"))
    moments = [base + timedelta(seconds=30 * k + 5) for k in range(500)]
    used = [usage("2024-01-20", notebook="/nb", start=m) for m in moments]
    got = sorted(r.usage_start_time for r in unmatched_rows(tables(spark, usage=used, tags=tags), CLOCK).collect())
    assert got == [m for m in moments if not any(a <= m <= b for a, b in spans)] and got

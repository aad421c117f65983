from datetime import timedelta

import pytest

from data import CLOCK, NOW, at, job, run, tables
from runledger.operators import health


def rows(df):
    return [tuple(r) for r in df.collect()]


def open_for(run_id, seconds, job=1):
    made = run(run_id, "30 10:00", None, None, job=job)
    made["period_start_time"] = NOW - timedelta(seconds=seconds)
    return made


def test_open_run_without_history(spark):
    t = tables(spark, runs=[open_for(1, 301), open_for(2, 300, job=2)])
    assert [(r.run_id, r.status, r.avg_duration_seconds) for r in health.health_prolonged(t, CLOCK).collect()] == [(1, "critical", 0.0)]


def test_open_run_against_usual_duration(spark):
    history = [run(10 + i, "20 10:00", "20 10:10") for i in range(3)]
    t = tables(spark, runs=history + [open_for(1, 901), open_for(2, 1201), open_for(3, 900)])
    assert [(r.run_id, r.status) for r in health.health_prolonged(t, CLOCK).collect()] == [(2, "critical"), (1, "warning")]


def baseline(durations, job=1):
    return [run(100 * job + i, "10 10:00", "10 11:00", job=job, duration=d) for i, d in enumerate(durations)]


def test_no_anomaly_without_spread_or_history(spark):
    recent = [run(1, "30 10:00", "30 11:00", job=1, duration=900), run(2, "30 10:00", "30 11:00", job=2, duration=900)]
    t = tables(spark, runs=recent + baseline([60] * 6, 1) + baseline([60, 61, 62, 63], 2))
    assert rows(health.health_anomalies(t, CLOCK)) == []


def test_anomaly_score(spark):
    t = tables(spark, runs=[run(1, "30 10:00", "30 11:00", duration=20)] + baseline([8, 9, 10, 11, 12]))
    got = health.health_anomalies(t, CLOCK).collect()
    assert [(r.avg_value, r.current_value, r.std_dev, r.z_score, r.severity) for r in got] == [(10.0, 20.0, 1.58, 6.32, "critical")]


def test_failed_jobs_threshold_and_rate(spark):
    made = [run(i, "30 10:00", "30 10:01", s, job=1) for i, s in enumerate(["FAILED", "SUCCEEDED", None])]
    made += [run(10 + i, "30 10:00", "30 10:01", "FAILED", job=2) for i in range(2)]
    t = tables(spark, runs=made)
    assert rows(health.health_failed_jobs(t, CLOCK)) == [(1, None, 3, 1, 66.67, at("30 10:00"))]


def test_same_name_in_two_workspaces_is_one_job(spark):
    made = [run(i, "30 10:00", "30 10:01", "FAILED" if i else "SUCCEEDED", job=1, ws=str(i % 2)) for i in range(4)]
    t = tables(spark, runs=made, jobs=[job(1, "one", "0"), job(1, "one", "1")])
    assert [(r.total_runs, r.failed_runs) for r in health.health_failed_jobs(t, CLOCK).collect()] == [(4, 3)]
    assert [(r.unique_runs, r.retry_attempts) for r in health.health_retries(t, CLOCK).collect()] == [(4, 3)]


def test_sla_counts_against_every_name_of_an_id(spark):
    made = [run(i, "30 10:00", "30 11:00", job=1, ws="0", duration=d) for i, d in enumerate([10, 10, 10, 50])]
    made += [run(10 + i, "30 10:00", "30 11:00", job=1, ws="1", duration=d) for i, d in enumerate([1, 1])]
    t = tables(spark, runs=made, jobs=[job(1, "a", "0"), job(1, "b", "1")])
    got = {r.job_name: (r.total_runs, r.sla_violations) for r in health.health_sla(t, CLOCK).collect()}
    # Above 2 x 20: one run; above 2 x 1: four runs; both names share the sum.
    assert got == {"a": (4, 5), "b": (2, 5)}


def test_percentiles_interpolate(spark):
    t = tables(spark, runs=[run(i, "20 10:00", "20 11:00", duration=d) for i, d in enumerate([1, 2, 3, 4, 10, 10])])
    assert rows(health.health_percentiles(t, CLOCK)) == [(1, None, 6, 3.5, 10.0, 10.0, 10.0)]
    assert rows(health.health_percentiles(tables(spark, runs=[run(i, "20 10:00", "20 11:00") for i in range(4)]), CLOCK)) == []


def test_health_metrics_of_single_run_have_no_spread(spark):
    got = health.job_health_metrics(tables(spark, runs=[run(1, "20 10:00", "20 10:01")]), CLOCK).collect()[0]
    assert (got.avg_duration_seconds, got.stddev_duration_seconds, got.health_status) == (60.0, None, "HEALTHY")


@pytest.mark.parametrize("good,verdict", [(19, "HEALTHY"), (16, "WARNING"), (15, "CRITICAL")])
def test_health_verdict(spark, good, verdict):
    made = [run(i, "20 10:00", "20 10:01", "SUCCEEDED" if i < good else "ERROR") for i in range(20)]
    assert health.job_health_metrics(tables(spark, runs=made), CLOCK).collect()[0].health_status == verdict


def test_score_of_nothing(spark):
    assert rows(health.health_score(tables(spark), CLOCK)) == [(100, 0, 0, 0, 0)]

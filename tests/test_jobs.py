import random
from datetime import datetime, timedelta

import pytest

from data import CLOCK, at, job, run, tables
from runledger.clock import Clock
from runledger.operators import intervals, jobs
from runledger.sources.tables import read_tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_summary_of_nothing_is_zeros(spark):
    assert rows(jobs.jobs_summary(tables(spark), CLOCK)) == [(0, 0, 0, 0, 0.0)]


def test_summary_counts_by_outcome(spark):
    states = ["SUCCEEDED", "SUCCESS", "FAILED", "ERROR", "TIMED_OUT", "RUNNING", None, "CANCELED"]
    t = tables(spark, runs=[run(i, "30 10:00", "30 10:01", s) for i, s in enumerate(states)])
    assert rows(jobs.jobs_summary(t, CLOCK)) == [(8, 2, 3, 2, 25.0)]


def test_window_is_bounded_on_both_sides(spark):
    t = tables(spark, runs=[run(1, "24 00:00", "24 00:01"), run(2, "23 23:59", "24 00:01"), run(3, "2024-01-31 00:00:01")])
    assert [r.run_id for r in jobs.jobs_runs(t, CLOCK).collect()] == [1]


def test_unknown_type_label_does_not_merge_groups(spark):
    made = [run(1, "30 10:00"), run(2, "30 10:00"), run(3, "30 10:00")]
    for r, kind in zip(made, [None, "UNKNOWN", None]):
        r["run_type"] = kind
    assert sorted(rows(jobs.jobs_by_type(tables(spark, runs=made), CLOCK))) == [("UNKNOWN", 1), ("UNKNOWN", 2)]


def test_matrix_names_and_order(spark):
    t = tables(spark, runs=[run(i, f"30 0{i}:00", f"30 0{i}:30", job=7) for i in range(5)] + [run(9, "30 01:00", "30 02:00", job=8)], jobs=[job(8, "eight")])
    got = {r.job_id: r for r in jobs.jobs_matrix(t, CLOCK, runs_per_job=3).collect()}
    assert got[7].job_name == "Job 7" and got[8].job_name == "eight"
    assert [x.run_id for x in got[7].runs] == [4, 3, 2]
    assert got[7].runs[0].duration_seconds == 1800.0
    assert [r.job_id for r in jobs.jobs_matrix(t, CLOCK, search="EIGH").collect()] == [8]
    assert [r.job_id for r in jobs.jobs_matrix(t, CLOCK, limit=1).collect()] == [7]


def test_search_matches_name_id_and_creator(spark):
    t = tables(spark, runs=[run(1, "30 10:00", job=12), run(2, "30 11:00", job=3), run(3, "30 12:00", job=4)], jobs=[job(3, "Alpha"), job(4, "x12")])
    found = lambda q, **k: [r.run_id for r in jobs.jobs_search(t, CLOCK, q, **k).collect()]
    assert found("12") == [3, 1]
    assert found("alpha@EX") == [2]
    assert found("") == [3, 2, 1]
    assert found("", page=1, page_size=2) == [1]


def test_timeline_places_open_runs_up_to_now(spark):
    t = tables(spark, runs=[run(1, "30 12:00", "30 18:00"), run(2, "30 18:00", None, None)])
    got = {r.run_id: r for r in jobs.jobs_timeline(t, CLOCK).collect()}
    assert (got[1].left_pct, got[1].width_pct) == (0.0, 50.0)
    assert (got[2].left_pct, got[2].width_pct, got[2].duration) == (50.0, 50.0, 21600.0)


def test_parameters_are_checked(spark):
    t = tables(spark)
    for call in (lambda: jobs.jobs_runs(t, CLOCK, days=91), lambda: jobs.jobs_runs(t, CLOCK, limit=0), lambda: intervals.jobs_overlaps(t, CLOCK, hours=169)):
        with pytest.raises(ValueError):
            call()


def test_broadcast_and_spread_lookups_agree(spark):
    made = [run(i, "30 10:00", "30 10:05", job=1 if i % 3 else i) for i in range(300)]
    names = [job(i, f"job {i}") for i in range(0, 300, 2)] + [job(1, "one")]
    results = [
        sorted(rows(jobs.with_job_name(tables(spark, runs=made, jobs=names, broadcast_rows=bound), tables(spark, runs=made).runs).select("run_id", "job_name")), key=str)
        for bound in (200_000, 0)
    ]
    assert results[0] == results[1] and len(results[0]) == 300


def brute_concurrency(runs, now, hours):
    cut = now - timedelta(hours=hours)
    live = [r for r in runs if cut <= r["period_start_time"] <= now]
    times = {r["period_start_time"] for r in live} | {r["period_end_time"] for r in runs if r["period_end_time"] and cut <= r["period_end_time"] <= now}
    counts = {t: sum(r["period_start_time"] <= t <= (r["period_end_time"] or now) for r in live) for t in times}
    return sorted((t, n) for t, n in counts.items() if n)


def brute_overlaps(runs, now, hours, limit):
    cut = now - timedelta(hours=hours)
    live = [r for r in runs if cut <= r["period_start_time"] <= now and r["period_end_time"] and r["period_end_time"] >= r["period_start_time"]]
    pairs = []
    for a in live:
        for b in live:
            if int(a["run_id"]) < int(b["run_id"]) and a["period_start_time"] < b["period_end_time"] and a["period_end_time"] > b["period_start_time"]:
                pairs.append((max(a["period_start_time"], b["period_start_time"]), int(a["run_id"]), int(b["run_id"])))
    pairs.sort(key=lambda p: (-p[0].timestamp(), p[1], p[2]))
    return pairs[:limit]


def random_runs(seed, n, grid_seconds):
    rng = random.Random(seed)
    base = datetime(2024, 1, 29, 20)
    made = []
    for i in rng.sample(range(10 * n), n):
        start = base + timedelta(seconds=grid_seconds * rng.randrange(0, 24 * 3600 // grid_seconds), microseconds=rng.choice([0, 0, 1, 999_999]))
        length = rng.choice([0, 0, 1, 30, 3600, 7200, 40_000])
        made.append(run(i, start.isoformat(sep=" "), (start + timedelta(seconds=length)).isoformat(sep=" ") if rng.random() > 0.1 else None, job=i % 7))
    return made


@pytest.mark.parametrize("seed,n,grid", [(1, 120, 1), (2, 200, 3600), (3, 60, 12 * 3600), (4, 90, 600)])
def test_interval_operators_equal_brute_force(spark, seed, n, grid):
    made = random_runs(seed, n, grid)
    t = tables(spark, runs=made)
    assert rows(intervals.jobs_concurrency(t, CLOCK)) == brute_concurrency(made, CLOCK.as_of, 24)
    assert rows(intervals.jobs_concurrency_tail(t, CLOCK)) == brute_concurrency(made, CLOCK.as_of, 24)[-50:]
    for limit in (1, 7, 100):
        got = [(r.overlap_start, r.run_id_1, r.run_id_2) for r in intervals.jobs_overlaps(t, CLOCK, limit=limit).collect()]
        assert got == brute_overlaps(made, CLOCK.as_of, 24, limit)


def test_all_runs_at_one_instant(spark):
    made = [run(i, "30 10:00", "30 11:00", job=i) for i in range(400)]
    t = tables(spark, runs=made)
    got = [(r.run_id_1, r.run_id_2) for r in intervals.jobs_overlaps(t, CLOCK).collect()]
    assert got == [(0, i) for i in range(1, 101)]
    assert rows(intervals.jobs_concurrency(t, CLOCK)) == [(at("30 10:00"), 400), (at("30 11:00"), 400)]


def test_both_ends_count_but_touching_runs_do_not_overlap(spark):
    t = tables(spark, runs=[run(1, "30 10:00", "30 11:00"), run(2, "30 11:00", "30 12:00")])
    assert dict(rows(intervals.jobs_concurrency(t, CLOCK)))[at("30 11:00")] == 2
    assert intervals.jobs_overlaps(t, CLOCK).count() == 0


def test_zero_length_run_overlaps_the_run_around_it(spark):
    t = tables(spark, runs=[run(1, "30 10:30", "30 10:30"), run(2, "30 10:00", "30 11:00")])
    assert [(r.run_id_1, r.run_id_2) for r in intervals.jobs_overlaps(t, CLOCK).collect()] == [(1, 2)]


def test_open_runs_are_concurrent_but_never_overlap(spark):
    t = tables(spark, runs=[run(1, "30 10:00", None, None), run(2, "30 20:00", "30 21:00")])
    assert dict(rows(intervals.jobs_concurrency(t, CLOCK)))[at("30 20:00")] == 2
    assert intervals.jobs_overlaps(t, CLOCK).count() == 0


def test_run_that_ends_before_it_starts_is_never_live(spark):
    t = tables(spark, runs=[run(1, "30 10:00", "30 09:00", duration=1), run(2, "30 08:00", "30 12:00")])
    assert rows(intervals.jobs_concurrency(t, CLOCK)) == [(at("30 08:00"), 1), (at("30 09:00"), 1), (at("30 10:00"), 1), (at("30 12:00"), 1)]


def test_results_do_not_depend_on_the_session_zone(spark):
    clock = Clock(datetime(2024, 3, 11))
    made = [run(i, f"2024-03-10 0{i}:30:00", f"2024-03-10 0{i + 2}:00:00") for i in range(4)]
    t = tables(spark, runs=made)
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        results = []
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            results.append(rows(intervals.jobs_concurrency(t, clock)))
        assert results[0] == results[1] == brute_concurrency(made, clock.as_of, 24)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_time_window_and_columns_reach_the_scan(spark, tmp_path):
    tables(spark, runs=[run(1, "30 10:00", "30 11:00")]).runs.write.parquet(f"{tmp_path}/runs")
    t = read_tables(spark, {"runs": f"{tmp_path}/runs"})
    plan = jobs.jobs_summary(t, CLOCK)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(period_start_time,2024-01-24T00:00)" in plan
    assert "ReadSchema: struct<period_start_time:timestamp_ntz,result_state:string>" in plan
    assert rows(jobs.jobs_summary(t, CLOCK)) == [(1, 1, 0, 0, 100.0)]


def test_concurrency_reads_its_input_once(spark, tmp_path):
    tables(spark, runs=random_runs(5, 50, 60)).runs.write.parquet(f"{tmp_path}/runs")
    t = read_tables(spark, {"runs": f"{tmp_path}/runs"})
    df = intervals.jobs_concurrency(t, CLOCK)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and "NestedLoop" not in final


def test_rows_that_end_before_they_start_are_counted(spark):
    made = [run(1, "30 10:00", "30 09:00"), run(2, "30 10:00", "30 11:00"), run(3, "30 12:00"), run(4, "30 12:00", "30 12:00")]
    row = intervals.jobs_misordered(tables(spark, runs=made), CLOCK).first()
    assert (row.misordered_runs, row.runs) == (1, 4)
    assert intervals.jobs_misordered(tables(spark), CLOCK).first().runs == 0


def test_overlaps_join_on_nodes(spark):
    """No nested loop over runs and instants, also for runs of months."""
    made = [run(1, "30 01:00", "2024-05-01 00:00:00"), run(2, "30 02:00", "2026-01-30 03:00:00"), run(3, "30 02:30", "30 02:31")]
    found = intervals.jobs_overlaps(tables(spark, runs=made), CLOCK)
    assert [(r.run_id_1, r.run_id_2) for r in found.collect()] == [(1, 3), (2, 3), (1, 2)]
    assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()

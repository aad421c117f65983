from datetime import datetime, timedelta

from pyspark.sql import functions as F

from data import CLOCK, at, frame, tables, tag
from runledger import schemas
from runledger.operators import tags
from runledger.sinks.policies import tag_policy_seed, write_policies
from runledger.sinks.tag_log import normalise_starts, tag_log_close, tag_log_ingest
from runledger.sources.tables import Tables, seed_policies
from runledger.streaming.tag_log_stream import read_ends, read_starts, start_tag_log, tag_log_stream

GOOD = dict(project_code="AB-123", cost_center="CC1234", department="Finance", environment="dev")


def rows(df):
    return [tuple(r) for r in df.collect()]


def broken(spark, *made):
    t = tables(spark, tags=[tag(i, **{**GOOD, **m}) for i, m in enumerate(made)])
    return sorted((r.correlation_id, r.tag_key, r.rule) for r in tags.tags_validate(t).collect())


def test_valid_record_breaks_nothing(spark):
    assert broken(spark, {}) == []


def test_empty_required_value_is_missing_only(spark):
    assert broken(spark, dict(project_code=""), dict(environment=None)) == [(0, "project_code", "missing"), (1, "environment", "missing")]


def test_value_may_break_two_rules(spark):
    both = spark.createDataFrame([("department", None, None, None, False, ["A", "B"], None, "[AB]$", True)], schemas.TAG_POLICY)
    t = tables(spark, tags=[tag(1, department="C")])
    t = Tables(tags=t.tags, policies=both)
    got = {r.rule: r.message for r in tags.tags_validate(t).collect()}
    assert got == {
        "not_allowed": "Tag 'department' value 'C' not in allowed values: ['A', 'B']",
        "pattern": "Tag 'department' value 'C' doesn't match pattern: [AB]$",
    }


def test_pattern_is_anchored_at_the_start_only(spark):
    rule = spark.createDataFrame([("department", None, None, None, False, None, None, "ab|cd", True)], schemas.TAG_POLICY)
    t = Tables(tags=tables(spark, tags=[tag(i, department=d) for i, d in enumerate(["abx", "cdx", "xab"])]).tags, policies=rule)
    assert [r.correlation_id for r in tags.tags_validate(t).collect()] == [2]


def test_inactive_policies_are_ignored(spark):
    off = seed_policies(spark).withColumn("is_active", F.lit(False))
    t = Tables(tags=tables(spark, tags=[tag(1)]).tags, policies=off)
    assert tags.tags_validate(t).count() == 0
    assert rows(tags.tags_validity(t)) == [(1, 0, True)]


def test_policies_order_and_fallbacks(spark):
    t = tables(spark)
    assert [r.tag_key for r in tags.tags_policies(t).collect()] == [
        "cost_center", "department", "environment", "project_code", "application_name", "business_unit", "owner_email",
    ]
    assert sorted(r.tag_key for r in tags.tags_required(t).collect()) == ["cost_center", "department", "environment", "project_code"]
    assert rows(tags.tags_defaults(t)) == [("environment", "dev")]
    none = Tables()
    assert [r.tag_key for r in tags.tags_policies(none, spark=spark).collect()] == ["project_code", "department", "environment", "cost_center"]
    assert [r.tag_key for r in tags.tags_required(none, spark=spark).collect()] == ["project_code", "cost_center", "department", "environment"]
    assert rows(tags.tags_defaults(none, spark=spark)) == [("environment", "dev")]


def test_defaults_fill_missing_values_only(spark):
    t = tables(spark, tags=[tag(1, environment=None), tag(2, environment=""), tag(3, environment="prod", department="")])
    got = {r.correlation_id: (r.environment, r.department) for r in tags.tags_fill_defaults(t).collect()}
    assert got == {1: ("dev", None), 2: ("dev", None), 3: ("prod", "")}


def test_summary_of_nothing_is_zeros(spark):
    assert set(tags.tags_summary(tables(spark), CLOCK).collect()[0]) == {0}


def start(run_id, when, given, notebook="/nb"):
    return dict(job_run_id=run_id, notebook_path=notebook, start_time=at(when), tags=given)


def end(run_id, when, status="SUCCESS"):
    return dict(job_run_id=run_id, end_time=at(when), status=status)


def test_start_events_become_running_records(spark):
    events = frame(spark, schemas.TAG_STARTS, [
        start("1", "20 10:00", {"project_code": "AB-1", "team": "x", "empty": "", "run_status": "no", "adf_run_id": ""}),
        start("2", "20 10:00", {"environment": "prod"}),
    ])
    got = {r.job_run_id: r for r in normalise_starts(events).collect()}
    assert got["1"].custom_tags == {"team": "x"} and got["1"].environment == "dev" and got["1"].adf_run_id is None
    assert got["2"].custom_tags is None and got["2"].environment == "prod"
    assert (got["1"].run_status, got["1"].run_end_time, got["1"].run_start_time) == ("RUNNING", None, at("20 10:00"))
    text = events.withColumn("tags", F.to_json("tags"))
    assert sorted(rows(normalise_starts(text)), key=str) == sorted(rows(normalise_starts(events)), key=str)
    assert normalise_starts(events).schema.simpleString() == schemas.TAG_LOG.simpleString()


def closed(spark, starts, ends):
    log = normalise_starts(frame(spark, schemas.TAG_STARTS, starts))
    got = tag_log_close(log, frame(spark, schemas.TAG_ENDS, ends)).collect()
    return sorted((r.job_run_id or "", r.run_start_time, r.run_end_time, r.run_status) for r in got)


def test_first_close_wins(spark):
    got = closed(spark, [start("1", "20 10:00", {})], [end("1", "20 12:00", "FAILED"), end("1", "20 11:00")])
    assert got == [("1", at("20 10:00"), at("20 11:00"), "SUCCESS")]


def test_close_reaches_only_records_that_exist(spark):
    starts = [start("1", w, {}) for w in ("20 10:00", "20 10:30", "20 12:00", "25 00:00")] + [start(None, "20 10:00", {}), start("2", "20 10:00", {})]
    ends = [end("1", "20 09:00", "EARLY"), end("1", "20 11:00", "A"), end("1", "20 12:00", "B"), end("1", "22 00:00", "C"), end(None, "20 11:00")]
    assert closed(spark, starts, ends) == [
        ("", at("20 10:00"), None, "RUNNING"),
        ("1", at("20 10:00"), at("20 11:00"), "A"),
        ("1", at("20 10:30"), at("20 11:00"), "A"),
        ("1", at("20 12:00"), at("20 12:00"), "B"),
        ("1", at("25 00:00"), None, "RUNNING"),
        ("2", at("20 10:00"), None, "RUNNING"),
    ]


def test_many_closes_of_one_run_equal_brute_force(spark):
    base = datetime(2024, 1, 20, 10)
    starts = [dict(start("1", "20 10:00", {}), start_time=base + timedelta(milliseconds=700 * i)) for i in range(40)]
    ends = [dict(end("1", "20 10:00"), end_time=base + timedelta(milliseconds=1900 * i, seconds=3700 * (i // 8))) for i in range(24)]
    times = sorted(e["end_time"] for e in ends)
    want = [next((e for e in times if e >= s["start_time"]), None) for s in starts]
    assert [r[2] for r in closed(spark, starts, ends)] == want


def test_stored_log_is_partitioned_and_clustered(spark, tmp_path):
    events = frame(spark, schemas.TAG_STARTS, [start(str(i), f"{20 + i % 3} 10:00", {"project_code": f"P-{i % 5}"}) for i in range(30)])
    path = f"{tmp_path}/log"
    tag_log_ingest(events, path)
    tag_log_ingest(events, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 60
    assert sorted(str(r.run_date) for r in stored.select("run_date").distinct().collect()) == ["2024-01-20", "2024-01-21", "2024-01-22"]
    recent = tags.recent_tags(Tables(tags=stored), CLOCK, 10)
    assert recent.count() == 40
    assert "PartitionFilters: [isnotnull(run_date" in recent._jdf.queryExecution().toString()


def test_seeding_twice_adds_nothing(spark, tmp_path):
    mine = seed_policies(spark).filter("tag_key = 'department'").withColumn("is_active", F.lit(False))
    once = tag_policy_seed(mine)
    assert once.count() == 7 and not once.filter("tag_key = 'department'").first().is_active
    write_policies(once, f"{tmp_path}/policies")
    twice = tag_policy_seed(spark.read.parquet(f"{tmp_path}/policies"))
    assert sorted(rows(twice), key=str) == sorted(rows(once), key=str) and twice.count() == 7


def test_stream_pairs_events_and_gives_up_on_open_runs(spark, tmp_path):
    def put(kind, schema, batch, made):
        frame(spark, schema, made).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{kind}")

    first = [start("1", "10 10:00", {"project_code": "P-1"}), start("2", "10 10:00", {}), start("3", "12 10:00", {})]
    put("starts", schemas.TAG_STARTS, 0, first)
    put("ends", schemas.TAG_ENDS, 0, [end("1", "10 11:00"), end("3", "12 11:00", "FAILED")])
    records = tag_log_stream(read_starts(spark, f"{tmp_path}/starts"), read_ends(spark, f"{tmp_path}/ends"))

    def advance():
        start_tag_log(records, f"{tmp_path}/log", f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
        return {r.job_run_id: (r.run_end_time, r.run_status) for r in spark.read.parquet(f"{tmp_path}/log").collect()}

    # Only what no further end can change comes out: run 3 may still get an earlier one.
    assert advance() == {"1": (at("10 11:00"), "SUCCESS"), "2": (None, "RUNNING")}
    # Run 3 gets a later end, one before its start, and last the one that counts.
    put("ends", schemas.TAG_ENDS, 1, [end("3", "12 15:00", "SUCCESS"), end("3", "12 09:55", "SKIPPED"), end("1", "10 15:00", "FAILED")])
    assert "3" not in advance()
    put("ends", schemas.TAG_ENDS, 2, [end("3", "12 10:30", "CANCELLED")])
    put("starts", schemas.TAG_STARTS, 1, [start("4", "20 12:00", {})])
    put("ends", schemas.TAG_ENDS, 3, [end("4", "20 13:00")])
    done = advance()
    rows = spark.read.parquet(f"{tmp_path}/log").collect()
    assert sorted(r.job_run_id for r in rows) == ["1", "2", "3"]
    ends = [end("1", "10 11:00"), end("1", "10 15:00", "FAILED"), end("3", "12 11:00", "FAILED"), end("3", "12 15:00"), end("3", "12 09:55", "SKIPPED"), end("3", "12 10:30", "CANCELLED")]
    batch = closed(spark, first, ends)
    assert {r[0]: r[2:] for r in batch} == done

"""Small hand-made inputs."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from runledger import schemas
from runledger.clock import Clock
from runledger.sources.tables import Tables, seed_policies

NOW = datetime(2024, 1, 31)
CLOCK = Clock(NOW)


def at(text: str) -> datetime:
    """``30 10:00`` is the 30th of January; a longer text is taken as it is."""
    return datetime.fromisoformat(f"2024-01-{text}" if len(text) <= 15 else text)


def frame(spark, schema, rows):
    names = schema.names
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)


def run(run_id, start, end=None, state="SUCCEEDED", job="1", ws="0", duration=None, **more):
    start, end = at(start), at(end) if end else None
    if duration is None and end is not None:
        duration = int((end - start).total_seconds())
    return dict(workspace_id=ws, job_id=str(job), run_id=str(run_id), run_name=f"run-{run_id}", run_type="JOB_RUN",
                period_start_time=start, period_end_time=end, result_state=state, execution_duration_seconds=duration, **more)


def job(job_id, name, ws="0", deleted=None):
    return dict(workspace_id=ws, job_id=str(job_id), name=name, creator_user_name=f"{name}@example.com", delete_time=deleted)


def usage(day, qty=1, sku="JOBS_COMPUTE", cloud="AWS", run_id=None, notebook=None, start=None, **more):
    day = date.fromisoformat(day)
    row = dict(usage_date=day, workspace_id="0", cloud=cloud, sku_name=sku, billing_origin_product="JOBS", usage_quantity=Decimal(qty),
               is_serverless=True, run_as="a@example.com", job_id="1", job_name="one", job_run_id=run_id, notebook_path=notebook,
               usage_start_time=start or datetime(day.year, day.month, day.day, 12), usage_end_time=None)
    return {**row, **more}


def price(sku, cloud, amount, start="2020-01-01 00:00:00", end=None):
    return dict(sku_name=sku, cloud=cloud, unit_price=Decimal(amount), price_start_time=at(start), price_end_time=at(end) if end else None)


def tag(cid, run_id=None, notebook=None, start="20 00:00", end=None, **more):
    return dict(correlation_id=cid, job_run_id=run_id, notebook_path=notebook, run_start_time=at(start), run_end_time=at(end) if end else None,
                run_status="SUCCESS", **more)


def tables(spark, runs=(), jobs=(), usage=(), prices=(), tags=(), **more) -> Tables:
    return Tables(
        runs=frame(spark, schemas.JOB_RUNS, runs),
        jobs=frame(spark, schemas.JOBS, jobs),
        usage=frame(spark, schemas.USAGE, usage),
        list_prices=frame(spark, schemas.LIST_PRICES, prices),
        tags=frame(spark, schemas.TAG_LOG, tags),
        policies=seed_policies(spark),
        **more,
    )

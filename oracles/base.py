"""The six inputs as common table expressions and the clock of the test data."""

from __future__ import annotations

import re

from runledger.sources import fixture_sql

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
TODAY = "DATE '2024-01-31'"

_PRICED = f"""
SELECT u.*, CAST(u.usage_quantity * COALESCE((
         SELECT p.unit_price FROM list_prices p
         WHERE p.sku_name = u.sku_name AND p.price_start_time <= u.usage_date
           AND (p.price_end_time IS NULL OR p.price_end_time > u.usage_date)
         ORDER BY CASE WHEN p.cloud = u.cloud THEN 0 ELSE 1 END, p.price_start_time DESC, p.cloud LIMIT 1),
       CAST(0.15 AS DECIMAL(10,4))) AS DECIMAL(29,10)) AS cost
FROM usage u
"""

BILLED = f"""
SELECT usage_date, workspace_id, job_id, job_run_id, notebook_path, sku_name, usage_quantity AS dbus,
       cost AS estimated_cost_usd, usage_start_time, usage_end_time
FROM priced
WHERE is_serverless AND billing_origin_product IN ('JOBS', 'INTERACTIVE', 'WORKFLOWS')
  AND usage_date BETWEEN {TODAY} - 90 AND {TODAY}
"""

_ATTRIBUTED = f"""
SELECT b.*, t.correlation_id, t.adf_pipeline_name, t.adf_run_id, t.project_code, t.cost_center, t.department,
       t.business_unit, t.environment, t.application_name, t.owner_email, t.run_status, t.created_by,
       CASE WHEN t.correlation_id IS NULL THEN 'UNMATCHED' ELSE 'MATCHED' END AS correlation_status
FROM billed b LEFT JOIN tags t
  ON b.job_run_id = t.job_run_id
  OR (b.notebook_path = t.notebook_path
      AND b.usage_start_time BETWEEN t.run_start_time AND COALESCE(t.run_end_time, {NOW}))
"""

_NAMED_RUNS = """
SELECT r.*, j.name AS job_name, j.creator_user_name FROM runs r LEFT JOIN jobs j USING (job_id, workspace_id)
"""

_CURRENT = """
SELECT u.*, p.unit_price, u.usage_quantity * COALESCE(p.unit_price, 0) AS cost
FROM usage u LEFT JOIN list_prices p ON p.sku_name = u.sku_name AND p.cloud = u.cloud AND p.price_end_time IS NULL
"""

_SUMMARY = """
SELECT usage_date, project_code, cost_center, department, environment, application_name, adf_pipeline_name,
       COUNT(DISTINCT job_run_id) AS job_runs, COUNT(DISTINCT notebook_path) AS unique_notebooks,
       SUM(dbus) AS total_dbus, SUM(estimated_cost_usd) AS total_cost_usd, AVG(CAST(dbus AS DOUBLE)) AS avg_dbus_per_run,
       MAX(estimated_cost_usd) AS max_run_cost,
       COUNT(*) FILTER (WHERE correlation_status = 'MATCHED') AS matched_runs,
       COUNT(*) FILTER (WHERE correlation_status = 'UNMATCHED') AS unmatched_runs,
       ROUND(COUNT(*) FILTER (WHERE correlation_status = 'MATCHED') * 100.0 / COUNT(*), 2) AS correlation_rate_pct
FROM attributed GROUP BY 1, 2, 3, 4, 5, 6, 7
"""

_WEEKLY = """
SELECT CAST(date_trunc('week', usage_date) AS DATE) AS week_start, project_code, department, SUM(dbus) AS weekly_dbus,
       SUM(estimated_cost_usd) AS weekly_cost_usd, COUNT(DISTINCT job_run_id) AS weekly_job_runs
FROM attributed GROUP BY 1, 2, 3
"""

_TABLES = {
    "runs": fixture_sql.RUNS,
    "jobs": fixture_sql.JOBS,
    "usage": fixture_sql.USAGE,
    "list_prices": fixture_sql.LIST_PRICES,
    "tags": fixture_sql.TAGS,
    "named_runs": _NAMED_RUNS,
    "current_cost": _CURRENT,
    "priced": _PRICED,
    "billed": BILLED,
    "attributed": _ATTRIBUTED,
    "summary": _SUMMARY,
    "weekly": _WEEKLY,
}


def query(body: str, **local: str) -> str:
    """A statement preceded by the inputs it reads; ``local`` adds expressions of its own."""
    tables = {**_TABLES, **local}

    def needed(sql: str) -> set[str]:
        names = {n for n in re.findall(r"(?:FROM|JOIN)\s+([a-z_]+)", sql) if n in tables}
        return names.union(*(needed(tables[n]) for n in names)) if names else names

    wanted = needed(body)
    parts = [f"{name} AS ({sql.strip()})" for name, sql in tables.items() if name in wanted]
    sql = (f"WITH {', '.join(parts)}\n" if parts else "") + body.strip()
    return sql.replace("{ts}", "TIMESTAMP")



def days(n: int, column: str = "period_start_time") -> str:
    return f"{column} >= {NOW} - INTERVAL {n} DAY AND {column} <= {NOW}"


def dates(n: int) -> str:
    return f"usage_date BETWEEN {TODAY} - {n} AND {TODAY}"


BAD = "('FAILED', 'ERROR', 'TIMED_OUT')"

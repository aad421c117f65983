"""Oracles of the cost queries and the derived cost tables."""

from oracles.base import BILLED, TODAY, dates, query

_CATEGORY = """CASE WHEN UPPER(sku_name) LIKE '%SERVERLESS%' AND UPPER(sku_name) LIKE '%SQL%' THEN 'Serverless SQL'
            WHEN UPPER(sku_name) LIKE '%SERVERLESS%' AND UPPER(sku_name) LIKE '%JOB%' THEN 'Serverless Jobs'
            WHEN UPPER(sku_name) LIKE '%SERVERLESS%' AND contains(UPPER(sku_name), 'ALL_PURPOSE') THEN 'Serverless Compute'
            WHEN UPPER(sku_name) LIKE '%SERVERLESS%' AND UPPER(sku_name) LIKE '%DATABASE%' THEN 'Serverless Database'
            WHEN contains(UPPER(sku_name), 'MODEL_SERVING') OR UPPER(sku_name) LIKE '%INFERENCE%' THEN 'Model Serving'
            WHEN UPPER(sku_name) LIKE '%SQL%' AND UPPER(sku_name) LIKE '%PRO%' THEN 'SQL Pro'
            WHEN UPPER(sku_name) LIKE '%SQL%' THEN 'SQL Warehouse'
            WHEN UPPER(sku_name) LIKE '%DLT%' THEN 'Delta Live Tables'
            WHEN contains(UPPER(sku_name), 'ALL_PURPOSE') THEN 'All-Purpose Compute'
            WHEN UPPER(sku_name) LIKE '%JOB%' THEN 'Jobs Compute'
            WHEN regexp_matches(UPPER(sku_name), 'OLTP|LAKEBASE|DATABASE') THEN 'Lakebase/OLTP' ELSE 'Other' END"""
_USD = "CAST(COALESCE(ROUND({}, 2), 0) AS DOUBLE)"


def usd(expression: str) -> str:
    return _USD.format(expression)


_PRICE_COLUMNS = """usage_date, workspace_id, cloud, sku_name, billing_origin_product, CAST(usage_quantity AS DOUBLE) AS usage_quantity,
       is_serverless, run_as, job_id, job_name, job_run_id, notebook_path, usage_start_time, usage_end_time"""
_ROLL = f"""
SELECT week_start, {usd('SUM(weekly_cost_usd)')} AS cost, {usd('SUM(weekly_dbus)')} AS dbus, CAST(SUM(weekly_job_runs) AS BIGINT) AS job_runs
FROM weekly WHERE week_start >= {TODAY} - 56 GROUP BY 1
"""
_DEPARTMENTS = f"""
SELECT COALESCE(department, 'Unknown') AS department, {usd('SUM(total_cost_usd)')} AS total_cost, {usd('SUM(total_dbus)')} AS total_dbus,
       CAST(SUM(job_runs) AS BIGINT) AS job_runs, COUNT(DISTINCT project_code) AS project_count,
       (SELECT COUNT(DISTINCT a.job_run_id) FROM attributed a
        WHERE a.department IS NOT DISTINCT FROM summary.department AND a.{dates(30)}) AS job_runs_distinct
FROM summary WHERE {dates(30)} GROUP BY summary.department
"""
_WEEKS = """
SELECT *, CASE WHEN prev IS NULL THEN NULL WHEN prev > 0 THEN ROUND((cost - prev) / prev * 100, 2) ELSE 0 END AS wow_change_pct
FROM (SELECT *, LAG(cost) OVER (ORDER BY week_start) AS prev FROM rolled)"""

SQL = {
    "price_usage_current": query(f"""
SELECT {_PRICE_COLUMNS}, CAST(COALESCE(unit_price, 0) AS DOUBLE) AS unit_price, CAST(cost AS DOUBLE) AS cost FROM current_cost WHERE {dates(90)}"""),
    "price_usage_asof": query(f"""
SELECT {_PRICE_COLUMNS}, CAST(CAST(cost / usage_quantity AS DECIMAL(10,4)) AS DOUBLE) AS unit_price, CAST(cost AS DOUBLE) AS cost
FROM priced WHERE {dates(90)}"""),
    "price_usage_flat": query(f"""
SELECT {_PRICE_COLUMNS}, CAST(0.15 AS DOUBLE) AS unit_price, CAST(usage_quantity * 0.15 AS DOUBLE) AS cost FROM usage WHERE {dates(90)}"""),
    "costs_summary": query(f"""
SELECT {usd('SUM(cost)')} AS total_cost_usd, {usd('SUM(usage_quantity)')} AS total_dbus, COUNT(DISTINCT job_id) AS unique_jobs,
       COUNT(DISTINCT job_run_id) AS total_runs, ROUND(CAST(SUM(cost) AS DOUBLE) / COUNT(DISTINCT job_run_id), 4) AS avg_cost_per_run,
       ROUND(CAST(SUM(cost) AS DOUBLE) / 30, 2) AS avg_daily_cost
FROM current_cost WHERE {dates(30)}"""),
    "costs_daily": query(f"""
SELECT usage_date AS date, {usd('SUM(cost)')} AS cost, {usd('SUM(usage_quantity)')} AS dbus, COUNT(DISTINCT job_run_id) AS job_runs
FROM current_cost WHERE {dates(30)} GROUP BY 1"""),
    "costs_top_jobs": query(f"""
SELECT job_id, workspace_id, COALESCE(MIN(job_name), 'Job ' || job_id) AS job_name, MIN(notebook_path) AS notebook_path,
       {usd('SUM(cost)')} AS total_cost, {usd('SUM(usage_quantity)')} AS total_dbus,
       CAST(MAX(runs) AS BIGINT) AS run_count, ROUND(CAST(SUM(cost) AS DOUBLE) / GREATEST(MAX(runs), 1), 4) AS avg_cost_per_run,
       FIRST(sku_name ORDER BY sku_cost DESC, sku_name) AS primary_sku, cloud, 'https://localhost/jobs/' || job_id AS job_url
FROM (SELECT c.*, SUM(cost) OVER (PARTITION BY job_id, workspace_id, cloud, sku_name) AS sku_cost, r.runs
      FROM current_cost c JOIN (SELECT job_id, workspace_id, cloud, COUNT(DISTINCT job_run_id) AS runs FROM usage
                                WHERE {dates(30)} GROUP BY 1, 2, 3) r USING (job_id, workspace_id, cloud)
      WHERE {dates(30)}) x
GROUP BY job_id, workspace_id, cloud ORDER BY SUM(cost) DESC, job_id, workspace_id, cloud LIMIT 10"""),
    "costs_by_identity": query(f"""
SELECT COALESCE(run_as, 'Unknown') AS identity, {usd('SUM(usage_quantity * 0.15)')} AS total_cost, {usd('SUM(usage_quantity)')} AS total_dbus,
       COUNT(DISTINCT job_run_id) AS job_runs
FROM usage WHERE {dates(30)} AND is_serverless GROUP BY run_as ORDER BY SUM(usage_quantity) DESC, run_as NULLS FIRST LIMIT 20"""),
    "costs_by_sku": query(f"""
SELECT sku_name, cloud, {_CATEGORY} AS category, CAST(COALESCE(unit_price, 0) AS DOUBLE) AS unit_price,
       {usd('SUM(usage_quantity)')} AS total_dbus, {usd('SUM(cost)')} AS total_cost, COUNT(DISTINCT job_id) AS job_count,
       COUNT(DISTINCT workspace_id) AS workspace_count
FROM current_cost WHERE {dates(30)} GROUP BY sku_name, cloud, unit_price ORDER BY SUM(cost) DESC, sku_name, cloud LIMIT 20"""),
    "sku_labels": query(f"""
SELECT sku_name, COUNT(*) AS usage_rows, {_CATEGORY} AS category,
       COALESCE(NULLIF(array_to_string(string_split(sku_name, '_')[2:3], ' '), ''), 'N/A') AS short_label
FROM usage WHERE {dates(90)} GROUP BY sku_name"""),
    "costs_trends_flat": query(f"""
SELECT CAST(date_trunc('week', usage_date) AS DATE) AS week_start, {usd('SUM(usage_quantity * 0.15)')} AS cost,
       {usd('SUM(usage_quantity)')} AS dbus, COUNT(DISTINCT job_run_id) AS job_runs
FROM usage WHERE {dates(56)} AND is_serverless GROUP BY 1"""),
    "cost_by_tags": query("""
SELECT * REPLACE (CAST(dbus AS DOUBLE) AS dbus, CAST(estimated_cost_usd AS DOUBLE) AS estimated_cost_usd) FROM attributed"""),
    "cost_summary": query("""
SELECT * REPLACE (CAST(total_dbus AS DOUBLE) AS total_dbus, CAST(total_cost_usd AS DOUBLE) AS total_cost_usd,
                  CAST(max_run_cost AS DOUBLE) AS max_run_cost) FROM summary"""),
    "cost_trends_wow": query("""
SELECT week_start, project_code, department, CAST(weekly_dbus AS DOUBLE) AS weekly_dbus, CAST(weekly_cost_usd AS DOUBLE) AS weekly_cost_usd,
       weekly_job_runs, CAST(prev AS DOUBLE) AS prev_week_cost,
       ROUND((CAST(weekly_cost_usd AS DOUBLE) - CAST(prev AS DOUBLE)) * 100 / NULLIF(CAST(prev AS DOUBLE), 0), 2) AS wow_change_pct
FROM (SELECT *, LAG(weekly_cost_usd) OVER (PARTITION BY project_code, department ORDER BY week_start) AS prev FROM weekly)"""),
    "unmatched_usage": query("""
SELECT usage_date, workspace_id, job_id, job_run_id, notebook_path, sku_name, CAST(dbus AS DOUBLE) AS dbus,
       CAST(estimated_cost_usd AS DOUBLE) AS estimated_cost_usd, usage_start_time, usage_end_time
FROM attributed WHERE correlation_id IS NULL"""),
    "costs_by_project": query(f"""
SELECT COALESCE(project_code, 'Untagged') AS project_code, COALESCE(department, 'Unknown') AS department,
       {usd('SUM(total_cost_usd)')} AS total_cost, {usd('SUM(total_dbus)')} AS total_dbus, CAST(SUM(job_runs) AS BIGINT) AS job_runs,
       (SELECT COUNT(DISTINCT a.job_run_id) FROM attributed a
        WHERE a.department IS NOT DISTINCT FROM summary.department AND a.project_code IS NOT DISTINCT FROM summary.project_code
          AND a.{dates(30)}) AS job_runs_distinct
FROM summary WHERE {dates(30)} GROUP BY summary.project_code, summary.department"""),
    "costs_by_department": query("SELECT * FROM departments", departments=_DEPARTMENTS),
    "costs_department_share": query(
        "SELECT *, ROUND(total_cost * 100.0 / SUM(total_cost) OVER (), 2) AS share_pct FROM departments", departments=_DEPARTMENTS),
    "costs_trends": query(_WEEKS, rolled=_ROLL).replace("SELECT *, CASE", "SELECT * EXCLUDE (prev), CASE"),
    "costs_trends_year": query(_WEEKS, rolled=_ROLL.replace("- 56", "- 364"), billed=BILLED.replace("- 90", "- 364")).replace(
        "SELECT *, CASE", "SELECT * EXCLUDE (prev), CASE"
    ),
    "correlation_breakdown": query(f"""
SELECT correlation_status AS status, COUNT(*) AS count, {usd('SUM(estimated_cost_usd)')} AS cost FROM attributed WHERE {dates(7)} GROUP BY 1"""),
    "costs_correlation_rate": query(f"""
SELECT COUNT(*) AS total_records, COUNT(correlation_id) AS matched, COUNT(*) - COUNT(correlation_id) AS unmatched,
       ROUND(COUNT(correlation_id) * 100.0 / COUNT(*), 2) AS correlation_rate_pct
FROM attributed WHERE {dates(7)}"""),
    "costs_untagged_pct": query(f"""
SELECT {usd('SUM(estimated_cost_usd)')} AS total_cost, {usd('SUM(estimated_cost_usd) FILTER (WHERE correlation_id IS NULL)')} AS untagged_cost,
       ROUND(CAST(SUM(estimated_cost_usd) FILTER (WHERE correlation_id IS NULL) AS DOUBLE) * 100 / CAST(SUM(estimated_cost_usd) AS DOUBLE), 2) AS untagged_pct
FROM attributed WHERE {dates(30)}"""),
    "correlation_by_pipeline": query(f"""
SELECT COALESCE(adf_pipeline_name, 'Direct Execution') AS pipeline_name, COUNT(*) AS total_records, COUNT(correlation_id) AS matched,
       ROUND(COUNT(correlation_id) * 100.0 / COUNT(*), 2) AS correlation_rate_pct
FROM attributed WHERE {dates(30)} GROUP BY adf_pipeline_name"""),
    "costs_by_pipeline": query(f"""
SELECT COALESCE(adf_pipeline_name, 'Direct Execution') AS pipeline_name, {usd('SUM(estimated_cost_usd)')} AS total_cost,
       {usd('SUM(dbus)')} AS total_dbus, COUNT(DISTINCT job_run_id) AS job_runs
FROM attributed WHERE {dates(30)} GROUP BY adf_pipeline_name"""),
}

"""Oracles of the tag log queries."""

from oracles.base import dates, days, query

_POLICIES = """
SELECT * FROM (VALUES
  ('project_code', TRUE, NULL, '^[A-Z]{2,5}-[0-9]{3,6}$'),
  ('cost_center', TRUE, NULL, '^CC[0-9]{4,8}$'),
  ('department', TRUE, ['Engineering', 'Data Science', 'Analytics', 'Finance', 'Operations', 'Marketing', 'Healthcare', 'Research'], NULL),
  ('environment', TRUE, ['dev', 'test', 'staging', 'prod'], NULL),
  ('business_unit', FALSE, NULL, NULL),
  ('application_name', FALSE, NULL, NULL),
  ('owner_email', FALSE, NULL, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$')) AS p(tag_key, needed, allowed, pattern)
"""
_VALUES = " UNION ALL ".join(
    f"SELECT correlation_id, '{name}' AS tag_key, {name} AS value FROM tags"
    for name in ("project_code", "cost_center", "department", "business_unit", "environment", "application_name", "owner_email")
)
_BROKEN = """
SELECT correlation_id, tag_key, value, 'missing' AS rule, 'Required tag ''' || tag_key || ''' is missing' AS message
FROM long_tags JOIN policies USING (tag_key) WHERE needed AND COALESCE(value, '') = ''
UNION ALL
SELECT correlation_id, tag_key, value, 'not_allowed',
       'Tag ''' || tag_key || ''' value ''' || value || ''' not in allowed values: [''' || array_to_string(allowed, ''', ''') || ''']'
FROM long_tags JOIN policies USING (tag_key) WHERE value <> '' AND allowed IS NOT NULL AND NOT list_contains(allowed, value)
UNION ALL
SELECT correlation_id, tag_key, value, 'pattern', 'Tag ''' || tag_key || ''' value ''' || value || ''' doesn''t match pattern: ' || pattern
FROM long_tags JOIN policies USING (tag_key) WHERE value <> '' AND NOT regexp_matches(value, pattern)
"""
_CUSTOM = """
SELECT correlation_id, 'team' AS tag_key, CASE WHEN correlation_id % 2 = 0 THEN 'team-' || (correlation_id % 7) END AS value FROM tags
UNION ALL SELECT correlation_id, 'adf_pipeline_name', adf_pipeline_name FROM tags
UNION ALL SELECT correlation_id, 'no_such_tag', NULL FROM tags
"""
_CUSTOM_BROKEN = f"""
SELECT correlation_id, tag_key, value, 'missing' AS rule, 'Required tag ''' || tag_key || ''' is missing' AS message
FROM ({_CUSTOM}) WHERE COALESCE(value, '') = ''
UNION ALL
SELECT correlation_id, tag_key, value, 'pattern', 'Tag ''team'' value ''' || value || ''' doesn''t match pattern: ^team-[0-4]$'
FROM ({_CUSTOM}) WHERE tag_key = 'team' AND value <> '' AND NOT regexp_matches(value, '^team-[0-4]$')
"""
_CHECKS = {"policies": _POLICIES, "long_tags": _VALUES, "broken": _BROKEN}
_ENDS = """
SELECT job_run_id, run_end_time AS end_time, run_status AS status FROM tags WHERE run_end_time IS NOT NULL
UNION ALL
SELECT job_run_id, run_end_time + INTERVAL '90' MINUTE, 'CANCELLED' FROM tags WHERE run_end_time IS NOT NULL
UNION ALL
SELECT job_run_id, run_start_time - INTERVAL '5' MINUTE, 'SKIPPED' FROM tags
"""
_CLOSED = """
SELECT s.job_run_id, s.notebook_path, s.project_code, s.department, s.run_start_time, e.end_time AS run_end_time,
       COALESCE(e.status, 'RUNNING') AS run_status
FROM tags s LEFT JOIN (SELECT t.job_run_id, MIN(ends.end_time) AS end_time, ARG_MIN(ends.status, ends.end_time) AS status
                       FROM tags t JOIN ends ON ends.job_run_id = t.job_run_id AND ends.end_time >= t.run_start_time GROUP BY 1) e
  ON e.job_run_id = s.job_run_id"""

SQL = {
    "tags_recent": query(f"""
SELECT correlation_id, job_run_id, notebook_path, adf_pipeline_name, adf_run_id, project_code, department, environment, run_status, run_start_time
FROM tags WHERE {days(7, 'run_start_time')} ORDER BY run_start_time DESC, correlation_id LIMIT 100"""),
    "tags_recent_filtered": query(f"""
SELECT correlation_id, job_run_id, notebook_path, adf_pipeline_name, adf_run_id, project_code, department, environment, run_status, run_start_time
FROM tags WHERE {days(90, 'run_start_time')} AND project_code = 'PROJ-005' AND department = 'MACHINERY'
ORDER BY run_start_time DESC, correlation_id LIMIT 1000"""),
    "tags_summary": query(f"""
SELECT COUNT(*) AS total_records, COUNT(DISTINCT project_code) AS unique_projects, COUNT(DISTINCT department) AS unique_departments,
       COUNT(DISTINCT adf_pipeline_name) AS unique_pipelines, COUNT(*) FILTER (WHERE run_status = 'SUCCESS') AS successful,
       COUNT(*) FILTER (WHERE run_status = 'FAILED') AS failed, ROUND(COUNT(project_code) * 100.0 / COUNT(*), 2) AS project_code_pct,
       ROUND(COUNT(department) * 100.0 / COUNT(*), 2) AS department_pct
FROM tags WHERE {days(30, 'run_start_time')}"""),
    "tags_by_pipeline": query(f"""
SELECT COALESCE(adf_pipeline_name, 'Direct Execution') AS pipeline_name, COUNT(*) AS job_runs, COUNT(DISTINCT project_code) AS unique_projects,
       COUNT(DISTINCT department) AS unique_departments, COUNT(*) FILTER (WHERE run_status = 'SUCCESS') AS successful,
       COUNT(*) FILTER (WHERE run_status = 'FAILED') AS failed,
       ROUND(COUNT(*) FILTER (WHERE run_status = 'SUCCESS') * 100.0 / COUNT(*), 2) AS success_rate_pct
FROM tags WHERE {days(30, 'run_start_time')} GROUP BY adf_pipeline_name ORDER BY job_runs DESC, adf_pipeline_name NULLS FIRST LIMIT 20"""),
    "tags_unmatched": query(f"""
SELECT usage_date, workspace_id, job_id, job_run_id, notebook_path, sku_name, CAST(ROUND(dbus, 2) AS DOUBLE) AS dbus,
       CAST(ROUND(estimated_cost_usd, 4) AS DOUBLE) AS estimated_cost_usd
FROM attributed WHERE correlation_id IS NULL AND {dates(7)}
ORDER BY attributed.estimated_cost_usd DESC, usage_date, job_run_id NULLS FIRST, sku_name, usage_start_time LIMIT 50"""),
    "tags_validate": query("SELECT * FROM broken", **_CHECKS),
    "tags_validity": query("""
SELECT tags.correlation_id, COUNT(broken.rule) AS errors, COUNT(broken.rule) = 0 AS is_valid
FROM tags LEFT JOIN broken ON broken.correlation_id = tags.correlation_id GROUP BY 1""", **_CHECKS),
    # Policies on a custom tag, on a column outside the usual ones, and on neither.
    "tags_validate_custom": query(_CUSTOM_BROKEN),
    "tags_fill_defaults": query("""
SELECT * REPLACE (COALESCE(NULLIF(environment, ''), 'dev') AS environment) FROM tags"""),
    "tag_log_ingest": query("""
SELECT job_run_id, notebook_path, adf_pipeline_name, adf_run_id, project_code, cost_center, department, business_unit,
       CASE WHEN correlation_id % 3 = 0 THEN 'dev' ELSE environment END AS environment, application_name, owner_email,
       CASE WHEN correlation_id % 2 = 0 THEN 'team-' || (correlation_id % 7) END AS custom_team, run_start_time,
       CAST(NULL AS TIMESTAMP) AS run_end_time, 'RUNNING' AS run_status, created_by
FROM tags"""),
    "tag_log_close": query(_CLOSED, ends=_ENDS),
    "tag_log_stored": query("SELECT * FROM tags"),
    # A record comes out once no end can come any more: an hour of lateness and a day for the run.
    "tag_log_stream": query(f"""
SELECT * FROM ({_CLOSED}) closed
WHERE run_start_time < (SELECT LEAST(MAX(run_start_time), MAX(run_end_time + INTERVAL '90' MINUTE)) FROM tags) - INTERVAL 25 HOUR""", ends=_ENDS),
    "tag_log_stream_flushed": query(_CLOSED, ends=_ENDS),
}

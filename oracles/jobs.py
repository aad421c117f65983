"""Oracles of the run monitoring queries."""

from oracles.base import BAD, NOW, days, query

_LISTED = """CAST(job_id AS BIGINT) AS job_id, job_name, CAST(run_id AS BIGINT) AS run_id, result_state, run_type,
       period_start_time AS start_time, period_end_time AS end_time, execution_duration_seconds AS execution_duration, creator_user_name"""
_CLASS = """CASE WHEN UPPER(result_state) IN ('SUCCESS', 'SUCCEEDED', 'COMPLETED', 'HEALTHY', 'COMPLIANT') THEN 'success'
            WHEN UPPER(result_state) IN ('FAILED', 'ERROR', 'CRITICAL', 'NON_COMPLIANT') THEN 'error'
            WHEN UPPER(result_state) IN ('RUNNING', 'PENDING', 'IN_PROGRESS', 'WARNING', 'AT_RISK') THEN 'warning' ELSE 'default' END"""
_LABEL = """CASE WHEN COALESCE(execution_duration_seconds, 0) = 0 THEN '-'
            WHEN execution_duration_seconds < 60 THEN execution_duration_seconds || 's'
            WHEN execution_duration_seconds < 3600 THEN execution_duration_seconds // 60 || 'm ' || execution_duration_seconds % 60 || 's'
            ELSE execution_duration_seconds // 3600 || 'h ' || execution_duration_seconds % 3600 // 60 || 'm' END"""
_RANKED = f"""
SELECT CAST(job_id AS BIGINT) AS job_id, job_name, CAST(run_id AS BIGINT) AS run_id, result_state, period_start_time AS start_time,
       execution_duration_seconds AS duration_seconds,
       ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY period_start_time DESC, CAST(run_id AS BIGINT) DESC) AS rn
FROM named_runs WHERE {days(30)}
"""
_POINTS = f"""
SELECT period_start_time AS t FROM runs WHERE period_start_time >= {NOW} - INTERVAL 168 HOUR AND period_start_time <= {NOW}
UNION
SELECT period_end_time FROM runs WHERE period_end_time >= {NOW} - INTERVAL 168 HOUR AND period_end_time <= {NOW}
"""
_CURVE = f"""
SELECT t AS time, COUNT(*) AS concurrent_jobs
FROM points JOIN runs ON t >= period_start_time AND t <= COALESCE(period_end_time, {NOW})
WHERE period_start_time >= {NOW} - INTERVAL 168 HOUR AND period_start_time <= {NOW}
GROUP BY t
"""
_NEWEST = f"SELECT * FROM named_runs WHERE {days(1)} ORDER BY period_start_time DESC, CAST(run_id AS BIGINT) LIMIT 30"
_SECONDS = "(date_diff('microsecond', {}, {}) / 1e6)"

SQL = {
    "jobs_runs": query(f"""
SELECT {_LISTED} FROM named_runs WHERE {days(7)} ORDER BY period_start_time DESC, CAST(run_id AS BIGINT) LIMIT 100"""),
    "jobs_runs_failed": query(f"""
SELECT {_LISTED} FROM named_runs WHERE {days(90)} AND result_state = 'FAILED'
ORDER BY period_start_time DESC, CAST(run_id AS BIGINT) LIMIT 1000"""),
    "jobs_summary": query(f"""
SELECT COUNT(*) AS total_runs, COUNT(*) FILTER (WHERE result_state IN ('SUCCEEDED', 'SUCCESS')) AS succeeded,
       COUNT(*) FILTER (WHERE result_state IN {BAD}) AS failed,
       COUNT(*) FILTER (WHERE COALESCE(result_state, 'RUNNING') = 'RUNNING') AS running,
       ROUND(COUNT(*) FILTER (WHERE result_state IN ('SUCCEEDED', 'SUCCESS')) * 100.0 / COUNT(*), 2) AS success_rate
FROM runs WHERE {days(7)}"""),
    "jobs_daily": query(f"""
SELECT CAST(period_start_time AS DATE) AS date, COUNT(*) AS total,
       COUNT(*) FILTER (WHERE result_state IN ('SUCCEEDED', 'SUCCESS')) AS succeeded,
       COUNT(*) FILTER (WHERE result_state IN {BAD}) AS failed
FROM runs WHERE {days(30)} GROUP BY 1"""),
    "jobs_by_type": query(f"""
SELECT COALESCE(run_type, 'UNKNOWN') AS run_type, n AS count
FROM (SELECT run_type, COUNT(*) AS n FROM runs WHERE {days(7)} GROUP BY run_type)"""),
    "jobs_type_share": query(f"""
SELECT COALESCE(run_type, 'UNKNOWN') AS run_type, n AS count, ROUND(n * 100.0 / SUM(n) OVER (), 2) AS share_pct
FROM (SELECT run_type, COUNT(*) AS n FROM runs WHERE {days(30)} GROUP BY run_type)"""),
    "jobs_matrix_flat": query("""
SELECT job_id, job_name, run_id, result_state, start_time, duration_seconds, CAST(rn AS INT) AS rn
FROM ranked WHERE rn <= 10 AND job_id IN (SELECT DISTINCT job_id FROM ranked ORDER BY job_id LIMIT 50)""", ranked=_RANKED),
    "jobs_matrix": query("""
SELECT job_id, COALESCE(NULLIF(FIRST(job_name ORDER BY rn), ''), 'Job ' || job_id) AS job_name,
       string_agg(concat_ws('|', run_id, COALESCE(result_state, '-'), strftime(start_time, '%Y-%m-%d %H:%M:%S'), COALESCE(CAST(duration_seconds AS BIGINT)::VARCHAR, '-')),
                  ';' ORDER BY rn) AS runs
FROM ranked WHERE rn <= 10 AND job_id IN (SELECT DISTINCT job_id FROM ranked ORDER BY job_id LIMIT 50) GROUP BY job_id""", ranked=_RANKED),
    "jobs_overlaps": query(f"""
SELECT CAST(a.job_id AS BIGINT) AS job_id_1, COALESCE(a.job_name, a.run_name) AS job_name_1, CAST(a.run_id AS BIGINT) AS run_id_1,
       CAST(b.job_id AS BIGINT) AS job_id_2, COALESCE(b.job_name, b.run_name) AS job_name_2, CAST(b.run_id AS BIGINT) AS run_id_2,
       GREATEST(a.period_start_time, b.period_start_time) AS overlap_start, LEAST(a.period_end_time, b.period_end_time) AS overlap_end
FROM named_runs a JOIN named_runs b
  ON CAST(a.run_id AS BIGINT) < CAST(b.run_id AS BIGINT)
 AND a.period_start_time < b.period_end_time AND a.period_end_time > b.period_start_time
WHERE a.period_start_time BETWEEN {NOW} - INTERVAL 168 HOUR AND {NOW}
  AND b.period_start_time BETWEEN {NOW} - INTERVAL 168 HOUR AND {NOW}
ORDER BY overlap_start DESC, run_id_1, run_id_2 LIMIT 100"""),
    "jobs_misordered": query(f"""
SELECT COUNT(*) FILTER (WHERE period_end_time < period_start_time) AS misordered_runs, COUNT(*) AS runs
FROM runs WHERE period_start_time BETWEEN {NOW} - INTERVAL 168 HOUR AND {NOW}"""),
    "jobs_concurrency": query("SELECT * FROM curve", points=_POINTS, curve=_CURVE),
    "jobs_concurrency_tail": query("SELECT * FROM curve ORDER BY time DESC LIMIT 50", points=_POINTS, curve=_CURVE),
    "jobs_search": query(f"""
SELECT {_LISTED}, {_CLASS} AS status_class, {_LABEL} AS duration_label
FROM named_runs
WHERE {days(30)} AND (contains(LOWER(job_name), 'user1') OR contains(job_id, 'user1') OR contains(LOWER(creator_user_name), 'user1'))
ORDER BY period_start_time DESC, CAST(run_id AS BIGINT) LIMIT 25 OFFSET 25"""),
    "jobs_timeline": query(f"""
SELECT CAST(job_id AS BIGINT) AS job_id, job_name, CAST(run_id AS BIGINT) AS run_id, result_state, run_type,
       period_start_time AS start_time, COALESCE(period_end_time, {NOW}) AS end_time,
       execution_duration_seconds AS execution_duration, creator_user_name,
       {_SECONDS.format('period_start_time', f'COALESCE(period_end_time, {NOW})')} AS duration,
       COALESCE(job_name, 'Job ' || job_id) AS display_name,
       ROUND({_SECONDS.format('(SELECT MIN(period_start_time) FROM newest)', 'period_start_time')} * 100
             / {_SECONDS.format('(SELECT MIN(period_start_time) FROM newest)', NOW)}, 4) AS left_pct,
       ROUND({_SECONDS.format('period_start_time', f'COALESCE(period_end_time, {NOW})')} * 100
             / {_SECONDS.format('(SELECT MIN(period_start_time) FROM newest)', NOW)}, 4) AS width_pct
FROM newest""", newest=_NEWEST),
    "jobs_active_count": query("SELECT COUNT(*) AS active_jobs FROM jobs WHERE delete_time IS NULL"),
    "jobs_longest": query(f"""
SELECT {_LISTED} FROM named_runs WHERE {days(30)} AND execution_duration_seconds IS NOT NULL
ORDER BY execution_duration_seconds DESC, CAST(run_id AS BIGINT) LIMIT 10"""),
    "jobs_status_labels": query(f"""
SELECT result_state, {_CLASS} AS status_class, {_LABEL} AS duration_label, COUNT(*) AS runs
FROM runs WHERE {days(30)} GROUP BY 1, 2, 3"""),
}

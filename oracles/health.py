"""Oracles of the job health queries."""

from oracles.base import BAD, NOW, days, query

_FAILED = f"""
SELECT CAST(job_id AS BIGINT) AS job_id, job_name, COUNT(*) AS total_runs, COUNT(*) FILTER (WHERE result_state IN {BAD}) AS failed_runs,
       ROUND(COUNT(*) FILTER (WHERE result_state IS NULL OR result_state NOT IN {BAD}) * 100.0 / COUNT(*), 2) AS success_rate,
       MAX(period_start_time) FILTER (WHERE result_state IN {BAD}) AS last_failure
FROM named_runs WHERE {days(7)} GROUP BY named_runs.job_id, job_name HAVING COUNT(*) >= 3 AND failed_runs > 0
"""
_USUAL = f"""
SELECT job_id, AVG(execution_duration_seconds) AS usual FROM runs WHERE {days(30)} AND result_state = 'SUCCEEDED' GROUP BY 1
"""
_LATE = f"""
SELECT CAST(r.job_id AS BIGINT) AS job_id, r.job_name, CAST(r.run_id AS BIGINT) AS run_id, r.period_start_time AS start_time,
       CAST(date_diff('second', r.period_start_time, {NOW}) AS DOUBLE) AS duration_seconds,
       COALESCE(u.usual, 0) AS avg_duration_seconds,
       CASE WHEN date_diff('second', r.period_start_time, {NOW}) > COALESCE(u.usual, 0) * 2.0 THEN 'critical' ELSE 'warning' END AS status
FROM named_runs r LEFT JOIN usual u ON u.job_id = r.job_id
WHERE COALESCE(r.result_state, 'RUNNING') = 'RUNNING'
  AND date_diff('second', r.period_start_time, {NOW}) > COALESCE(u.usual * 1.5, 300)
"""
_FINISHED = "('SUCCEEDED', 'FAILED', 'ERROR', 'TIMED_OUT')"
_RECENT = f"""
SELECT job_id, job_name, AVG(execution_duration_seconds) AS mean FROM named_runs
WHERE {days(7)} AND result_state IN {_FINISHED} GROUP BY 1, 2
"""
_BASE = f"""
SELECT job_id, AVG(execution_duration_seconds) AS mean, STDDEV_SAMP(execution_duration_seconds) AS sd FROM runs
WHERE period_start_time >= {NOW} - INTERVAL 30 DAY AND period_start_time < {NOW} - INTERVAL 7 DAY AND result_state IN {_FINISHED}
GROUP BY 1 HAVING COUNT(*) >= 5
"""
_ODD = """
SELECT CAST(r.job_id AS BIGINT) AS job_id, r.job_name, 'duration' AS metric, ROUND(r.mean, 2) AS current_value, ROUND(b.mean, 2) AS avg_value,
       ROUND(b.sd, 2) AS std_dev, ROUND((r.mean - b.mean) / b.sd, 2) AS z_score,
       CASE WHEN ABS((r.mean - b.mean) / b.sd) >= 3 THEN 'critical' ELSE 'warning' END AS severity, (r.mean - b.mean) / b.sd AS z
FROM recent r JOIN base b ON b.job_id = r.job_id
WHERE b.sd > 0 AND ABS((r.mean - b.mean) / b.sd) >= 2
"""
_ODD_ORDER = "ORDER BY ABS(z) DESC, job_id, job_name LIMIT 20"
_OK = f"SELECT CAST(job_id AS BIGINT) AS job_id, job_name, execution_duration_seconds AS d FROM named_runs WHERE {days(7)} AND result_state = 'SUCCEEDED'"
_MEANS = "SELECT job_id, job_name, COUNT(*) AS n, AVG(d) AS mean FROM ok GROUP BY 1, 2"
_OVER = "SELECT ok.job_id, COUNT(*) AS n FROM ok JOIN means ON means.job_id = ok.job_id WHERE ok.d > means.mean * 2.0 GROUP BY 1"
_SLA = """
SELECT s.job_id, s.job_name, s.n AS total_runs, ROUND(s.mean, 2) AS avg_duration_seconds, COALESCE(v.n, 0) AS sla_violations,
       ROUND((s.n - COALESCE(v.n, 0)) * 100.0 / s.n, 2) AS compliance_rate_pct,
       CASE WHEN ROUND((s.n - COALESCE(v.n, 0)) * 100.0 / s.n, 2) >= 95 THEN 'compliant'
            WHEN ROUND((s.n - COALESCE(v.n, 0)) * 100.0 / s.n, 2) >= 80 THEN 'at_risk' ELSE 'non_compliant' END AS status
FROM means s LEFT JOIN over_mean v ON v.job_id = s.job_id
"""
_SLA_ORDER = "ORDER BY sla_violations DESC, total_runs DESC, job_id, job_name LIMIT 50"
_SLA_PARTS = {"ok": _OK, "means": _MEANS, "over_mean": _OVER, "sla": _SLA}
_LATE_PARTS = {"usual": _USUAL, "late": _LATE}
_ODD_PARTS = {"recent": _RECENT, "base": _BASE, "odd": _ODD}

SQL = {
    "health_failed_jobs": query("SELECT * FROM failed ORDER BY failed_runs DESC, job_id, job_name LIMIT 20", failed=_FAILED),
    "job_success_rates": query(f"""
SELECT CAST(job_id AS BIGINT) AS job_id, job_name, COUNT(*) AS total_runs, COUNT(*) FILTER (WHERE result_state = 'SUCCEEDED') AS succeeded,
       COUNT(*) FILTER (WHERE result_state IN {BAD}) AS failed_runs,
       ROUND(COUNT(*) FILTER (WHERE result_state = 'SUCCEEDED') * 100.0 / COUNT(*), 2) AS success_rate
FROM named_runs WHERE {days(7)} GROUP BY named_runs.job_id, job_name"""),
    "health_prolonged": query("SELECT * FROM late", **_LATE_PARTS),
    "health_anomalies": query(f"SELECT * EXCLUDE (z) FROM odd {_ODD_ORDER}", **_ODD_PARTS),
    "health_retries": query(f"""
SELECT CAST(job_id AS BIGINT) AS job_id, job_name, COUNT(DISTINCT run_id) AS unique_runs, COUNT(DISTINCT run_id) AS total_attempts,
       COUNT(*) FILTER (WHERE result_state IN {BAD}) AS retry_attempts, COUNT(DISTINCT run_id) AS max_attempts,
       ROUND(COUNT(*) FILTER (WHERE result_state IN {BAD}) * 100.0 / COUNT(DISTINCT run_id), 2) AS retry_rate_pct
FROM named_runs WHERE {days(7)} GROUP BY named_runs.job_id, job_name
HAVING retry_attempts > 0 AND COUNT(*) FILTER (WHERE result_state = 'SUCCEEDED') > 0
ORDER BY retry_attempts DESC, CAST(named_runs.job_id AS BIGINT), job_name LIMIT 20"""),
    "health_sla": query(f"SELECT * FROM sla {_SLA_ORDER}", **_SLA_PARTS),
    "health_percentiles": query(f"""
SELECT CAST(job_id AS BIGINT) AS job_id, job_name, COUNT(*) AS run_count,
       ROUND(quantile_cont(execution_duration_seconds, 0.5), 2) AS p50_seconds, ROUND(quantile_cont(execution_duration_seconds, 0.9), 2) AS p90_seconds,
       ROUND(quantile_cont(execution_duration_seconds, 0.95), 2) AS p95_seconds, ROUND(quantile_cont(execution_duration_seconds, 0.99), 2) AS p99_seconds
FROM named_runs WHERE {days(30)} AND result_state = 'SUCCEEDED' GROUP BY named_runs.job_id, job_name HAVING COUNT(*) >= 5
ORDER BY p50_seconds DESC, CAST(named_runs.job_id AS BIGINT), job_name LIMIT 50"""),
    "job_health_metrics": query(f"""
SELECT CAST(job_id AS BIGINT) AS job_id, job_name, COUNT(*) AS total_runs,
       COUNT(*) FILTER (WHERE result_state IN ('SUCCESS', 'SUCCEEDED')) AS success_count, COUNT(*) FILTER (WHERE result_state = 'FAILED') AS failed_count,
       ROUND(COUNT(*) FILTER (WHERE result_state IN ('SUCCESS', 'SUCCEEDED')) * 100.0 / COUNT(*), 2) AS success_rate_pct,
       ROUND(AVG(execution_duration_seconds), 2) AS avg_duration_seconds, ROUND(STDDEV_SAMP(execution_duration_seconds), 2) AS stddev_duration_seconds,
       ROUND(quantile_cont(execution_duration_seconds, 0.5), 2) AS p50_duration, ROUND(quantile_cont(execution_duration_seconds, 0.9), 2) AS p90_duration,
       ROUND(quantile_cont(execution_duration_seconds, 0.95), 2) AS p95_duration, ROUND(quantile_cont(execution_duration_seconds, 0.99), 2) AS p99_duration,
       CASE WHEN AVG(CASE WHEN result_state IN ('SUCCESS', 'SUCCEEDED') THEN 1.0 ELSE 0.0 END) >= 0.95 THEN 'HEALTHY'
            WHEN AVG(CASE WHEN result_state IN ('SUCCESS', 'SUCCEEDED') THEN 1.0 ELSE 0.0 END) >= 0.80 THEN 'WARNING' ELSE 'CRITICAL' END AS health_status
FROM named_runs WHERE {days(30)} GROUP BY named_runs.job_id, job_name"""),
    "health_score": query("""
SELECT CAST(ROUND(COALESCE((SELECT AVG(CASE WHEN status = 'compliant' THEN 100.0 ELSE 0.0 END) FROM sla), 100)) AS BIGINT) AS health_score,
       (SELECT COUNT(*) FROM sla) AS sla_jobs, (SELECT COUNT(*) FROM failed) AS failed_jobs,
       (SELECT COUNT(*) FROM late) AS prolonged_runs, (SELECT COUNT(*) FROM odd) AS anomalies""",
        failed=_FAILED, **_LATE_PARTS, **_ODD_PARTS, **_SLA_PARTS),
}

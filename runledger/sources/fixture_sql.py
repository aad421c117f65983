"""SQL that shapes the generic test tables into the six inputs, shared by Spark and the oracle.

``{ts}`` stands for the zone-free timestamp type, which the two engines name differently. Every row
of the source tables is used; gaps that real data has (rare jobs, missing definitions, untagged runs)
are modelled by moving rows to other keys, not by leaving rows out.
"""

RUNS = """
SELECT CASE WHEN user_id % 20 = 9 AND event_id % 2 = 1 THEN '8' ELSE CAST(user_id % 4 AS STRING) END AS workspace_id,
       CAST(user_id AS STRING) AS job_id, CAST(event_id AS STRING) AS run_id,
       'run-' || CAST(event_id AS STRING) AS run_name,
       CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'SUBMIT_RUN' WHEN 2 THEN 'WORKFLOW_RUN' ELSE 'JOB_RUN' END AS run_type,
       CAST(ts AS {ts}) AS period_start_time,
       CASE WHEN state IS NULL OR state = 'RUNNING' THEN NULL ELSE CAST(ts AS {ts}) + INTERVAL '1' SECOND * dur END AS period_end_time,
       state AS result_state,
       CASE WHEN state IS NULL OR state = 'RUNNING' THEN NULL ELSE dur END AS execution_duration_seconds
FROM (SELECT user_id, event_id, ts,
       CAST(FLOOR(value * 60 * CASE WHEN user_id % 10 = 3 AND ts >= CAST('2024-01-24 00:00:00' AS {ts}) THEN 10 ELSE 1 END) AS BIGINT) AS dur,
       CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'RUNNING'
            WHEN event_type = 'view' AND event_id % 7 = 1 THEN NULL
            WHEN user_id % 8 = 5 THEN 'SUCCEEDED'
            WHEN event_type = 'error' THEN 'FAILED'
            WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'TIMED_OUT'
            WHEN event_type = 'signup' AND event_id % 3 = 1 THEN 'ERROR'
            ELSE 'SUCCEEDED' END AS state
      FROM (SELECT CASE WHEN user_id % 12 = 4 AND event_id % 10 <> 0 THEN user_id + 1 ELSE user_id END AS user_id,
                   event_id, ts, event_type, value
            FROM events) moved) e
"""

JOBS = """
SELECT CASE WHEN c_custkey % 10 = 7 THEN '9' ELSE CAST(c_custkey % 4 AS STRING) END AS workspace_id,
       CAST(c_custkey AS STRING) AS job_id, c_name AS name,
       'user' || CAST(c_nationkey AS STRING) || '@example.com' AS creator_user_name,
       CASE WHEN c_custkey % 50 = 1 THEN CAST('2024-01-15 00:00:00' AS {ts}) END AS delete_time
FROM customer
UNION ALL
SELECT '8', CAST(c_custkey AS STRING), c_name || '-ws8', 'user' || CAST(c_nationkey AS STRING) || '@example.com', CAST(NULL AS {ts})
FROM customer WHERE c_custkey % 20 = 9
"""

USAGE = """
SELECT usage_date, workspace_id, cloud, sku_name, usage_quantity, billing_origin_product, is_serverless, run_as,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_suppkey AS STRING) END AS job_id,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE 'job-' || CAST(l_suppkey AS STRING) END AS job_name,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_orderkey AS STRING) END AS job_run_id,
       CASE WHEN l_partkey % 4 = 0 THEN '/Repos/nb_' || CAST(l_partkey % 50 AS STRING) END AS notebook_path,
       CAST(usage_date AS {ts}) + INTERVAL '1' HOUR * (l_linenumber * 3) AS usage_start_time,
       CAST(usage_date AS {ts}) + INTERVAL '1' HOUR * (l_linenumber * 3 + 1) AS usage_end_time
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       DATE '2023-11-02' + CAST((l_orderkey * 13 + l_linenumber * 7 + l_partkey) % 90 AS INT) AS usage_date,
       CAST(l_suppkey % 4 AS STRING) AS workspace_id,
       CASE l_suppkey % 3 WHEN 0 THEN 'AWS' WHEN 1 THEN 'AZURE' ELSE 'GCP' END AS cloud,
       CASE l_partkey % 14 WHEN 0 THEN 'SERVERLESS_SQL_COMPUTE' WHEN 1 THEN 'JOBS_SERVERLESS_COMPUTE' WHEN 2 THEN 'ALL_PURPOSE_SERVERLESS_COMPUTE' WHEN 3 THEN 'DATABASE_SERVERLESS_COMPUTE' WHEN 4 THEN 'SERVERLESS_REAL_TIME_INFERENCE' WHEN 5 THEN 'MODEL_SERVING' WHEN 6 THEN 'SQL_PRO_COMPUTE' WHEN 7 THEN 'SQL_COMPUTE' WHEN 8 THEN 'DLT_CORE_COMPUTE' WHEN 9 THEN 'ALL_PURPOSE_COMPUTE' WHEN 10 THEN 'JOBS_COMPUTE' WHEN 11 THEN 'OLTP_COMPUTE' WHEN 12 THEN 'STORAGE_UNITS' WHEN 13 THEN 'UNPRICED_UNITS' END AS sku_name,
       CAST(l_quantity AS DECIMAL(18,6)) AS usage_quantity,
       CASE l_linenumber % 4 WHEN 0 THEN 'SQL' WHEN 1 THEN 'JOBS' WHEN 2 THEN 'INTERACTIVE' ELSE 'WORKFLOWS' END AS billing_origin_product,
       l_returnflag <> 'N' AS is_serverless,
       CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE 'user' || CAST(l_suppkey % 25 AS STRING) || '@example.com' END AS run_as
      FROM lineitem) l
"""

SKUS = (
    "SERVERLESS_SQL_COMPUTE",
    "JOBS_SERVERLESS_COMPUTE",
    "ALL_PURPOSE_SERVERLESS_COMPUTE",
    "DATABASE_SERVERLESS_COMPUTE",
    "SERVERLESS_REAL_TIME_INFERENCE",
    "MODEL_SERVING",
    "SQL_PRO_COMPUTE",
    "SQL_COMPUTE",
    "DLT_CORE_COMPUTE",
    "ALL_PURPOSE_COMPUTE",
    "JOBS_COMPUTE",
    "OLTP_COMPUTE",
    "STORAGE_UNITS",
)
CLOUDS = ("AWS", "AZURE", "GCP")
PRICE_CHANGE = "2023-12-15 00:00:00"
_PRICE_ROWS = ",\n  ".join(
    f"('{sku}', '{cloud}', {(10 + 5 * i + k + 2 * new) / 100:.2f}, "
    + (f"'{PRICE_CHANGE}', NULL)" if new else f"'2020-01-01 00:00:00', '{PRICE_CHANGE}')")
    for i, sku in enumerate(SKUS)
    for k, cloud in enumerate(CLOUDS)
    for new in (0, 1)
)
LIST_PRICES = f"""
SELECT sku_name, cloud, CAST(price AS DECIMAL(10,4)) AS unit_price,
       CAST(valid_from AS {{ts}}) AS price_start_time, CAST(valid_to AS {{ts}}) AS price_end_time
FROM (VALUES
  {_PRICE_ROWS}) AS p(sku_name, cloud, price, valid_from, valid_to)
"""

TAGS = """
SELECT o_orderkey AS correlation_id,
       CASE WHEN o_orderkey % 5 = 0 THEN 'unmetered-' ELSE '' END || CAST(o_orderkey AS STRING) AS job_run_id,
       CASE WHEN o_orderkey % 5 <> 0 THEN '/Repos/nb_' || CAST(o_custkey % 50 AS STRING) END AS notebook_path,
       CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'pl_' || CAST(o_custkey % 7 AS STRING) END AS adf_pipeline_name,
       'adf-' || CAST(o_orderkey AS STRING) AS adf_run_id,
       CASE WHEN o_custkey % 11 = 0 THEN NULL WHEN o_custkey % 17 = 0 THEN 'bad_code' ELSE 'PROJ-' || LPAD(CAST(o_custkey % 20 AS STRING), 3, '0') END AS project_code,
       'CC' || CAST(1000 + o_custkey % 8 AS STRING) AS cost_center,
       CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS department,
       CASE o_custkey % 3 WHEN 0 THEN NULL ELSE 'BU-' || CAST(o_custkey % 3 AS STRING) END AS business_unit,
       CASE o_orderkey % 5 WHEN 1 THEN 'dev' WHEN 2 THEN 'test' WHEN 3 THEN 'staging' ELSE 'prod' END AS environment,
       'app-' || CAST(o_custkey % 6 AS STRING) AS application_name,
       CASE WHEN o_custkey % 19 = 0 THEN 'not-an-email' ELSE 'owner' || CAST(o_custkey % 30 AS STRING) || '@example.com' END AS owner_email,
       st AS run_start_time,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE st + INTERVAL '1' HOUR * (o_orderkey % 6 + 1) END AS run_end_time,
       CASE WHEN o_orderkey % 97 = 0 THEN 'RUNNING' WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'SUCCESS' END AS run_status,
       'svc' || CAST(o_custkey % 3 AS STRING) AS created_by
FROM (SELECT o.*, c.c_mktsegment, CAST(DATE '2023-11-02' + CAST(o_orderkey % 90 AS INT) AS {ts}) + INTERVAL '1' HOUR * (o_orderkey % 24) AS st
      FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey) x
"""

"""Explicit schemas of the input tables and of the tag event log."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()
_TS, _D = T.TimestampNTZType(), T.DateType()
QUANTITY = T.DecimalType(18, 6)
PRICE = T.DecimalType(10, 4)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


JOB_RUNS = _struct(
    ("workspace_id", _S),
    ("job_id", _S),
    ("run_id", _S),
    ("run_name", _S),
    ("run_type", _S),
    ("period_start_time", _TS),
    ("period_end_time", _TS),
    ("result_state", _S),
    ("execution_duration_seconds", _L),
)

JOBS = _struct(
    ("workspace_id", _S),
    ("job_id", _S),
    ("name", _S),
    ("creator_user_name", _S),
    ("delete_time", _TS),
)

USAGE = _struct(
    ("usage_date", _D),
    ("workspace_id", _S),
    ("cloud", _S),
    ("sku_name", _S),
    ("billing_origin_product", _S),
    ("usage_quantity", QUANTITY),
    ("is_serverless", _B),
    ("run_as", _S),
    ("job_id", _S),
    ("job_name", _S),
    ("job_run_id", _S),
    ("notebook_path", _S),
    ("usage_start_time", _TS),
    ("usage_end_time", _TS),
)

# The metering source as delivered: attributes nested in structs.
USAGE_NESTED = _struct(
    ("usage_date", _D),
    ("workspace_id", _S),
    ("cloud", _S),
    ("sku_name", _S),
    ("billing_origin_product", _S),
    ("usage_quantity", QUANTITY),
    ("usage_metadata", _struct(("job_id", _S), ("job_run_id", _S), ("job_name", _S), ("notebook_path", _S))),
    ("identity_metadata", _struct(("run_as", _S))),
    ("product_features", _struct(("is_serverless", _B))),
    ("usage_start_time", _TS),
    ("usage_end_time", _TS),
)

LIST_PRICES = _struct(
    ("sku_name", _S),
    ("cloud", _S),
    ("unit_price", PRICE),
    ("price_start_time", _TS),
    ("price_end_time", _TS),
)

LIST_PRICES_NESTED = _struct(
    ("sku_name", _S),
    ("cloud", _S),
    ("pricing", _struct(("default", PRICE))),
    ("price_start_time", _TS),
    ("price_end_time", _TS),
)

TAG_LOG = _struct(
    ("correlation_id", _L),
    ("job_id", _S),
    ("job_run_id", _S),
    ("task_run_id", _S),
    ("notebook_id", _S),
    ("notebook_path", _S),
    ("workspace_id", _S),
    ("cluster_id", _S),
    ("adf_pipeline_name", _S),
    ("adf_pipeline_id", _S),
    ("adf_run_id", _S),
    ("adf_activity_name", _S),
    ("adf_trigger_name", _S),
    ("adf_trigger_time", _TS),
    ("adf_data_factory_name", _S),
    ("project_code", _S),
    ("cost_center", _S),
    ("department", _S),
    ("business_unit", _S),
    ("environment", _S),
    ("application_name", _S),
    ("owner_email", _S),
    ("custom_tags", T.MapType(_S, _S)),
    ("run_start_time", _TS),
    ("run_end_time", _TS),
    ("run_status", _S),
    ("created_by", _S),
    ("created_at", _TS),
    ("updated_at", _TS),
)

# A raw start event: the run's context plus the tags it was started with.
TAG_STARTS = _struct(
    ("job_id", _S),
    ("job_run_id", _S),
    ("task_run_id", _S),
    ("notebook_id", _S),
    ("notebook_path", _S),
    ("workspace_id", _S),
    ("cluster_id", _S),
    ("created_by", _S),
    ("start_time", _TS),
    ("tags", T.MapType(_S, _S)),
)

TAG_ENDS = _struct(("job_run_id", _S), ("end_time", _TS), ("status", _S))

TAG_POLICY = _struct(
    ("tag_key", _S),
    ("tag_display_name", _S),
    ("tag_description", _S),
    ("tag_category", _S),
    ("is_required", _B),
    ("allowed_values", T.ArrayType(_S)),
    ("default_value", _S),
    ("validation_regex", _S),
    ("is_active", _B),
)

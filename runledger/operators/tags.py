"""Tag log reports and checks of tag values against the policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from runledger import fixed_values as V
from runledger import schemas
from runledger.clock import Clock, check_range
from runledger.functions import pct
from runledger.sources.tables import Tables

# Policies that are read at most; more of them are taken for a mistake.
MOST_POLICIES = 1_000
# Columns of the tag log with business tags.
TAG_FIELDS = ["project_code", "cost_center", "department", "business_unit", "environment", "application_name", "owner_email"]


def recent_tags(t: Tables, clock: Clock, days: int) -> DataFrame:
    start = F.col("run_start_time")
    rows = t.tags.filter(clock.since_days(start, days))
    if "run_date" in t.tags.columns:
        # The stored log is partitioned by date: name the partitions too.
        rows = rows.filter(clock.on_dates(F.col("run_date"), days))
    return rows


def tags_recent(
    t: Tables, clock: Clock, days: int = 7, limit: int = 100, project_code: str | None = None, department: str | None = None
) -> DataFrame:
    """Newest tag records, optionally of one project or department."""
    check_range("days", days, 1, 90)
    check_range("limit", limit, 1, 1000)
    rows = recent_tags(t, clock, days)
    if project_code:
        rows = rows.filter(F.col("project_code") == project_code)
    if department:
        rows = rows.filter(F.col("department") == department)
    return rows.orderBy(F.desc("run_start_time"), "correlation_id").limit(limit).select(
        "correlation_id",
        "job_run_id",
        "notebook_path",
        "adf_pipeline_name",
        "adf_run_id",
        "project_code",
        "department",
        "environment",
        "run_status",
        "run_start_time",
    )


def tags_summary(t: Tables, clock: Clock, days: int = 30) -> DataFrame:
    """Size, variety and completeness of the tag log, one row."""
    check_range("days", days, 1, 90)
    counts = recent_tags(t, clock, days).agg(
        F.count("*").alias("total_records"),
        F.countDistinct("project_code").alias("unique_projects"),
        F.countDistinct("department").alias("unique_departments"),
        F.countDistinct("adf_pipeline_name").alias("unique_pipelines"),
        F.count("project_code").alias("_p"),
        F.count("department").alias("_d"),
        F.count_if(F.col("run_status") == "SUCCESS").alias("successful"),
        F.count_if(F.col("run_status") == "FAILED").alias("failed"),
    )
    total = F.col("total_records")
    return counts.withColumns(
        {"project_code_pct": pct(F.col("_p"), total), "department_pct": pct(F.col("_d"), total)}
    ).drop("_p", "_d")


def tags_by_pipeline(t: Tables, clock: Clock, days: int = 30, limit: int = 20) -> DataFrame:
    """Runs, variety and outcome per calling pipeline; NULL is labelled after grouping."""
    check_range("days", days, 1, 90)
    check_range("limit", limit, 1, 100)
    return (
        recent_tags(t, clock, days)
        .groupBy("adf_pipeline_name")
        .agg(
            F.count("*").alias("job_runs"),
            F.countDistinct("project_code").alias("unique_projects"),
            F.countDistinct("department").alias("unique_departments"),
            F.count_if(F.col("run_status") == "SUCCESS").alias("successful"),
            F.count_if(F.col("run_status") == "FAILED").alias("failed"),
        )
        .orderBy(F.desc("job_runs"), F.asc_nulls_first("adf_pipeline_name"))
        .limit(limit)
        .withColumn("success_rate_pct", pct(F.col("successful"), F.col("job_runs")))
        .withColumn("adf_pipeline_name", F.coalesce("adf_pipeline_name", F.lit(V.DIRECT_EXECUTION)))
        .withColumnRenamed("adf_pipeline_name", "pipeline_name")
    )


_POLICY_COLUMNS = [name for name in schemas.TAG_POLICY.names if name != "is_active"]


def tags_policies(t: Tables, active_only: bool = True, spark: SparkSession | None = None) -> DataFrame:
    """Policies, required ones first; a short built-in list where there is no policy table."""
    if t.policies is None:
        rows = [(key, label, None, None, True, None, default, None) for key, label, default in V.FALLBACK_POLICIES]
        kinds = schemas.TAG_POLICY.fields[: len(_POLICY_COLUMNS)]
        return (spark or t.spark).createDataFrame(rows, type(schemas.TAG_POLICY)(kinds))
    rows = t.policies.filter("is_active") if active_only else t.policies
    return rows.select(*_POLICY_COLUMNS).orderBy(F.desc("is_required"), "tag_key")


def tags_required(t: Tables, spark: SparkSession | None = None) -> DataFrame:
    """Keys every run must be tagged with."""
    if t.policies is None:
        return (spark or t.spark).createDataFrame([(key,) for key in V.FALLBACK_REQUIRED], "tag_key string")
    return t.policies.filter("is_active AND is_required").select("tag_key")


def tags_defaults(t: Tables, spark: SparkSession | None = None) -> DataFrame:
    """Default value per key."""
    if t.policies is None:
        return (spark or t.spark).createDataFrame(list(V.FALLBACK_DEFAULTS), "tag_key string, default_value string")
    return t.policies.filter("is_active AND default_value IS NOT NULL").select("tag_key", "default_value")


def tags_fill_defaults(t: Tables, fields: list[str] | None = None) -> DataFrame:
    """The tag log with missing values replaced by their defaults."""
    fields = TAG_FIELDS if fields is None else fields
    # One row whose map has at most an entry per tag key.
    defaults = tags_defaults(t, t.tags.sparkSession).select(
        F.map_from_entries(F.collect_list(F.struct("tag_key", "default_value")))
    ).scalar()
    filled = {name: F.coalesce(F.nullif(name, F.lit("")), F.element_at(defaults, F.lit(name)), F.col(name)) for name in fields}
    return t.tags.withColumns(filled)


def _rules(t: Tables, fields: list[str] | None) -> list[Row]:
    """Active policies (about ``fields`` only, if given): a setting of one row per tag, read by the driver."""
    policies = tags_policies(t, spark=t.tags.sparkSession)
    if fields is not None:
        policies = policies.filter(F.col("tag_key").isin(*fields))
    rows = policies.select("tag_key", "is_required", "allowed_values", "validation_regex").limit(MOST_POLICIES + 1).collect()
    if len(rows) > MOST_POLICIES:
        raise ValueError(f"tag policies: more than {MOST_POLICIES} active rows")
    if len({row.tag_key for row in rows}) < len(rows):
        raise ValueError("tag policies: more than one active row for a tag")
    return rows


def _value(tags: DataFrame, key: str) -> Column:
    """What a record says for a tag: its column of that name, else its custom tag, else NULL."""
    if key in tags.columns and dict(tags.dtypes)[key] == "string":
        return F.col(key)
    if "custom_tags" in tags.columns:
        return F.try_element_at("custom_tags", F.lit(key))
    return F.lit(None).cast("string")


def _violations(tags: DataFrame, rules: list[Row]) -> Column:
    """Array of the broken rules of a record, each with tag, value, rule and message."""
    found = []
    for policy in rules:
        value = _value(tags, policy.tag_key)
        empty = F.coalesce(value, F.lit("")) == ""
        quoted = F.concat(F.lit(f"Tag '{policy.tag_key}' value '"), value)

        def broken(rule, condition, message):
            return F.when(
                condition,
                F.struct(F.lit(policy.tag_key).alias("tag_key"), value.alias("value"), F.lit(rule).alias("rule"), message.alias("message")),
            )

        if policy.is_required:
            found.append(broken("missing", empty, F.lit(f"Required tag '{policy.tag_key}' is missing")))
        if policy.allowed_values:
            shown = "', '".join(policy.allowed_values)
            allowed = value.isin(*policy.allowed_values)
            found.append(broken("not_allowed", ~empty & ~allowed, F.concat(quoted, F.lit(f"' not in allowed values: ['{shown}']"))))
        if policy.validation_regex:
            matches = value.rlike(f"^(?:{policy.validation_regex})")
            found.append(broken("pattern", ~empty & ~matches, F.concat(quoted, F.lit(f"' doesn't match pattern: {policy.validation_regex}"))))
    if not found:
        return F.array().cast("array<struct<tag_key:string,value:string,rule:string,message:string>>")
    return F.array_compact(F.array(*found))


def tags_validate(t: Tables, key: str = "correlation_id", fields: list[str] | None = None) -> DataFrame:
    """One row per violated rule of an active policy: missing, not_allowed or pattern.

    Every active policy is applied, to a column, a custom tag or nothing (see ``_value``); ``fields`` restricts
    them. A missing required value breaks that rule only; any other value may break both of the others. Patterns are
    anchored at the start of the value.
    """
    rules = _rules(t, fields)
    return t.tags.select(key, F.explode(_violations(t.tags, rules)).alias("v")).select(key, "v.*")


def tags_validity(t: Tables, key: str = "correlation_id", fields: list[str] | None = None) -> DataFrame:
    """Per tag record whether it satisfies every policy, and the number of broken rules."""
    errors = F.size(_violations(t.tags, _rules(t, fields))).cast("bigint")
    return t.tags.select(key, errors.alias("errors")).withColumn("is_valid", F.col("errors") == 0)

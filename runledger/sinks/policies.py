"""Insert-only seeding of the tag policies."""

from __future__ import annotations

from pyspark.sql import DataFrame

from runledger.sources.tables import seed_policies


def tag_policy_seed(existing: DataFrame) -> DataFrame:
    """The policies with every missing default added; existing rows are untouched."""
    missing = seed_policies(existing.sparkSession).join(existing, "tag_key", "left_anti")
    return existing.unionByName(missing, allowMissingColumns=True)


def write_policies(policies: DataFrame, path: str) -> None:
    """Write the policy table to a new location; Spark cannot overwrite the path it is reading."""
    policies.coalesce(1).write.mode("errorifexists").parquet(path)

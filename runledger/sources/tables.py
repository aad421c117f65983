"""The input tables of a report and the checks they must pass."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runledger import fixed_values as V
from runledger import schemas

# Largest dimension that is sent to every executor: rows of a few short columns, tens of MB.
BROADCAST_ROWS = 200_000

Source = DataFrame | Callable[[], DataFrame] | None


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether a table has no more than ``rows`` rows; reads at most one row beyond that."""
    return df.limit(rows + 1).count() <= rows


class Tables:
    """The six inputs: ``runs``, ``jobs``, ``usage``, ``list_prices``, ``tags`` and ``policies``.

    Each is a DataFrame, a function that opens one when it is first needed, or None where there is no
    such table. ``broadcast_rows`` bounds what may be broadcast.
    """

    NAMES = ("runs", "jobs", "usage", "list_prices", "tags", "policies")

    def __init__(self, *, broadcast_rows: int = BROADCAST_ROWS, **given: Source) -> None:
        unknown = set(given) - set(self.NAMES)
        if unknown:
            raise TypeError(f"unknown tables: {sorted(unknown)}")
        self.broadcast_rows = broadcast_rows
        self._given = {name: given.get(name) for name in self.NAMES}

    def _open(self, name: str) -> DataFrame | None:
        source = self._given[name]
        if callable(source):
            source = self._given[name] = source()
        return source

    runs = property(lambda self: self._open("runs"))
    jobs = property(lambda self: self._open("jobs"))
    usage = property(lambda self: self._open("usage"))
    list_prices = property(lambda self: self._open("list_prices"))
    tags = property(lambda self: self._open("tags"))
    policies = property(lambda self: self._open("policies"))

    def replace(self, **changed: Source) -> "Tables":
        return Tables(broadcast_rows=self.broadcast_rows, **{**self._given, **changed})

    @property
    def spark(self) -> SparkSession:
        return next(self._open(name) for name in self.NAMES if self._given[name] is not None).sparkSession

    @cached_property
    def jobs_fit(self) -> bool:
        return at_most(self.jobs, self.broadcast_rows)

    def prices_fit(self, copies: int = 1) -> bool:
        """Whether the price list, repeated ``copies`` times per row, may be broadcast."""
        return at_most(self.list_prices, self.broadcast_rows // max(copies, 1))

    def checked(self) -> "Tables":
        """Fail early when a lookup key is not unique, which would repeat facts in every join."""
        if self.jobs is not None:
            require_unique(self.jobs, ["job_id", "workspace_id"], "jobs")
        if self.list_prices is not None:
            current = self.list_prices.filter(F.col("price_end_time").isNull())
            require_unique(current, ["sku_name", "cloud"], "current list prices")
        if self.policies is not None:
            require_unique(self.policies, ["tag_key"], "tag policies")
        return self

    def with_latest_definitions(self, order_by: str = "delete_time") -> "Tables":
        return self.replace(jobs=latest_definition(self.jobs, ["job_id", "workspace_id"], order_by))


def require_unique(df: DataFrame, keys: list[str], what: str) -> None:
    repeated = df.groupBy(*keys).count().filter("count > 1").limit(5)
    rows = [tuple(row)[:-1] for row in repeated.collect()]
    if rows:
        raise ValueError(f"{what}: more than one row for {keys}, for example {rows}")


def latest_definition(df: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """One row per key: a live definition (NULL) before the newest value of ``order_by``."""
    others = [F.col(c) for c in sorted(set(df.columns) - set(keys) - {order_by})]
    newest = Window.partitionBy(*keys).orderBy(F.desc_nulls_first(order_by), *others)
    return df.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def flatten_usage(nested: DataFrame) -> DataFrame:
    """The metering source with its struct attributes as plain columns."""
    return nested.select(
        "usage_date",
        "workspace_id",
        "cloud",
        "sku_name",
        "billing_origin_product",
        "usage_quantity",
        F.col("product_features.is_serverless").alias("is_serverless"),
        F.col("identity_metadata.run_as").alias("run_as"),
        F.col("usage_metadata.job_id").alias("job_id"),
        F.col("usage_metadata.job_name").alias("job_name"),
        F.col("usage_metadata.job_run_id").alias("job_run_id"),
        F.col("usage_metadata.notebook_path").alias("notebook_path"),
        "usage_start_time",
        "usage_end_time",
    )


def flatten_prices(nested: DataFrame) -> DataFrame:
    return nested.select(
        "sku_name", "cloud", F.col("pricing").getField("default").alias("unit_price"), "price_start_time", "price_end_time"
    )


def seed_policies(spark: SparkSession) -> DataFrame:
    """The tag policies of a new installation."""
    return spark.createDataFrame(list(V.POLICY_SEED), schemas.TAG_POLICY)


_SCHEMAS: dict[str, StructType] = {
    "runs": schemas.JOB_RUNS,
    "jobs": schemas.JOBS,
    "usage": schemas.USAGE,
    "list_prices": schemas.LIST_PRICES,
    "tags": schemas.TAG_LOG,
    "policies": schemas.TAG_POLICY,
}


def read_tables(spark: SparkSession, paths: Mapping[str, str], nested: bool = False) -> Tables:
    """Open parquet tables by name with declared schemas. ``nested`` reads the struct form of usage and prices."""
    kinds = dict(_SCHEMAS)
    if nested:
        kinds |= {"usage": schemas.USAGE_NESTED, "list_prices": schemas.LIST_PRICES_NESTED}
    frames = {name: spark.read.schema(kinds[name]).parquet(path) for name, path in paths.items()}
    if nested:
        for name, flatten in (("usage", flatten_usage), ("list_prices", flatten_prices)):
            if name in frames:
                frames[name] = flatten(frames[name])
    return Tables(**frames)

"""Intermediate tables on the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one in local mode where it is unset, else None."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.startswith("local["):
        folder = mkdtemp(prefix="runledger-")
    return folder


# Shuffle files of a query go when it ends; without it they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read back, for relations that several branches read; ``df`` itself where no folder is shared.

    The table outlives lost executors. It lies below the shared folder, which is its owner's to clear.
    """
    return kept_together({label: df})[0]


def _written(df: DataFrame, label: str) -> DataFrame:
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_together(frames: dict[str, DataFrame]) -> list[DataFrame]:
    """``kept`` for several relations, whose jobs share the cluster."""
    spark = next(iter(frames.values())).sparkSession
    with _shuffles_dropped(spark), ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(lambda item: _written(item[1], item[0]), frames.items()))

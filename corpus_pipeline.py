"""From raw documents to packed training sequences: poor texts, copies and near copies go, secrets are masked."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import exact_dedup, jaccard_join, packing, quality, secret_scan
from runledger.llm.registry import WORD_BPE
from runledger.llm.storage import stored

# Near copies share at least this percentage of their shingles of so many words.
SHINGLE, PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs, SHINGLE, PERCENT)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the masked text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset."""
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", keep_one_copy),
    ("jaccard_join", keep_one_of_group),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]
# Trees, tokenizers and packing are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

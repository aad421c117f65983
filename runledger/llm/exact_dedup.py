"""Exact copies by digest, with the frequent digests split off.

Digests are stored once in a narrow table. A Misra-Gries summary (the frequent-items sketch behind
``approx_top_k``) finds digests that may be frequent; their exact winners and sizes are then counted and
broadcast, so rows of frequent digests are decided where they are read. All other digests are shuffled as
usual, and none of their groups is large. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.storage import free_name, stored

WHITE_SPACE = r"[\x20\x09-\x0D]+"
# The sketch is kept per slice of the digests. At most SLICES * PER_SLICE digests are broadcast.
SLICES, PER_SLICE, TRACKED = 64, 64, 512


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without ASCII white space; NULL counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, ""), 256))


def _size(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    """One narrow row per document, numbered so that equal rows can be told apart."""
    text = F.col("text")
    narrow = docs.select("doc_id", _size(text).alias("size"), text_digest(text).alias("digest"))
    return stored(narrow.withColumn("row", F.monotonically_increasing_id()), "digests")


def _order() -> Column:
    """Smallest for the row that stays: most code points, then smallest doc_id (NULL last), then first row."""
    return F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.col("row").alias("row"))


def _frequent(keyed: DataFrame) -> DataFrame:
    """Winner and size of every frequent digest; at most SLICES * PER_SLICE candidates, counted exactly."""
    key = F.xxhash64("digest")
    top = F.expr(f"approx_top_k(key, {PER_SLICE}, {TRACKED})")
    candidates = (
        keyed.select(key.alias("key"))
        .groupBy(F.pmod("key", F.lit(SLICES)).alias("slice"))
        .agg(top.alias("top"), F.count("*").alias("n"))
        .select("n", F.inline("top"))
        .filter((F.col("count") > 1) & (F.col("count") * PER_SLICE >= F.col("n")))
        .select(F.col("item").alias("key"))
    )
    counted = (
        keyed.withColumn("key", key)
        .join(F.broadcast(candidates), "key", "left_semi")
        .groupBy("digest")
        .agg(F.min(_order()).alias("winner"), F.count("*").alias("group_size"))
    )
    return stored(counted, "frequent")


def _groups(docs: DataFrame) -> DataFrame:
    keyed = _keyed(docs)
    frequent = F.broadcast(_frequent(keyed))
    removed_early = keyed.join(frequent, "digest")
    same = Window.partitionBy("digest")
    rest = keyed.join(frequent.select("digest"), "digest", "left_anti").select(
        "*", F.min(_order()).over(same).alias("winner"), F.count("*").over(same).alias("group_size")
    )
    return removed_early.unionByName(rest).withColumn("kept", F.col("row") == F.col("winner.row"))


def exact_copies(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without ASCII white space; of equal texts the row with the most
    code points stays, then the one with the smallest doc_id. A NULL text is an empty one, so all empty,
    blank and NULL texts form one group. A NULL doc_id comes after all others. Of rows that repeat one
    another entirely exactly one is kept. Other columns are ignored; an empty table gives an empty result.
    """
    return _groups(docs).select(
        "doc_id",
        F.col("winner.id").alias("keep_id"),
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_copies`` keeps, with all their columns."""
    key = free_name(docs, "copy_key")
    kept = _groups(docs).filter("kept").select(F.struct("doc_id", "digest", "size").alias(key))
    text = F.col("text")
    keyed = docs.withColumn(key, F.struct("doc_id", text_digest(text).alias("digest"), _size(text).alias("size")))
    # Kept keys are unique; dropDuplicates tells repeated rows apart and needs no further shuffle.
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)

"""The operators applied to the given tables with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm import (
    bpe,
    chat_format,
    embedding_dedup,
    exact_dedup,
    jaccard_join,
    line_dedup,
    nearest,
    packing,
    prefix_trie,
    quality,
    secret_scan,
    token_alignment,
    toxicity,
)
from runledger.llm.storage import stored

Query = Callable[[SparkSession, str], DataFrame]
WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    narrow = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(stored(narrow, "pieces"))


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(table(spark, sf_dir, "documents"))


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    return bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def _spans_text(spans: Column) -> Column:
    kind = F.array(*map(F.lit, secret_scan.KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kind[s.kind], s.start.cast("string"), s.end.cast("string"))))


def _n_of_kind(spans: Column, name: str) -> Column:
    """A second parameter of the lambda, even one with a default, would be the place in the array."""
    kind = secret_scan.KINDS.index(name)
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{name}")


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    *of_base, added = (_n_of_kind(spans, name) for name in secret_scan.KINDS)
    base = F.filter(spans, lambda s: s.kind < 3)
    return secret_scan.secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *of_base, F.sha2(_spans_text(base), 256).alias("base_sha256"), _spans_text(spans).alias("spans"), added
    )


def _toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def _formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(*columns).unionByName(extra)
    return chat_format.conversation_digests(chat_format.format_conversations(turns))


def _near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def _repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    deleted = F.col("deleted")
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", F.size(deleted).cast("long").alias("n_deleted"), F.array_join(deleted.cast("array<string>"), ",").alias("deleted")
    )


def _trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def _alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.token_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_vectors(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_secret_scan": _secrets,
        "op2_toxicity": _toxic,
        "op3_best_fit_packing": _packed,
        "op4_quality_classifier": _quality,
        "op5_chat_format": _formatted,
        "op6_embedding_dedup": _near_vectors,
        "op7_exact_dedup": _exact,
        "op8_line_dedup": _repeated_lines,
        "op9_bpe": _encoded,
        "op10_jaccard_join": _similar,
        "op11_prefix_trie": _trie,
        "op12_token_alignment": _alignment,
        "op13_nearest": _nearest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": EXACT_SQL, "op11_prefix_trie": TRIE_SQL}


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST)
"""

# DuckDB has no CRC-32: the bytes are folded bit by bit. A node is the list of its turns; ancestors are its prefixes.
TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), cut AS (
  SELECT *, xor(list_reduce(list_transform(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
           lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda x: x),
           lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END, 4294967295), 4294967295) % 4 AS h
  FROM turns
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(f.own, [])[1:c.h], c.own[c.h + 1:]) AS s
  FROM cut c LEFT JOIN turns f ON f.conv_id = c.conv_id - c.conv_id % 20
), members AS (
  SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM rebuilt
), nodes AS (
  SELECT s[1:d] AS p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(s) = d), '')) AS ends_sha256
  FROM members GROUP BY 1, 2
), linked AS (
  SELECT n.*, u.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children,
         CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(regexp_extract_all(n.p[-1].t, '[^\x20\x09-\x0D]+')) END AS own_saved
  FROM nodes n LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]
  LEFT JOIN (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2) k
    ON k.depth = n.depth AND k.p = n.p
), totals AS (
  SELECT p, depth, sum(leaf) AS n_leaves, sum(own_saved) AS saved_tokens
  FROM (SELECT l.p[1:a.d] AS p, a.d AS depth, CAST(n_children = 0 AS INT) AS leaf, own_saved FROM linked l, unnest(range(l.depth + 1)) AS a(d))
  GROUP BY 1, 2
)
SELECT l.conv_id, l.depth, l.parent_conv_id, l.n_convs, l.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
       CAST(t.saved_tokens AS BIGINT) AS saved_tokens, l.ends_sha256
FROM linked l JOIN totals t ON t.depth = l.depth AND t.p = l.p
"""

"""Best-fit packing planned on a histogram of lengths.

Documents are cut into pieces of at most ``capacity`` tokens. Only the number of pieces of each length goes
to the driver (at most ``capacity`` numbers). There a best-fit-decreasing plan is made over counts: a run of
equally long pieces fills a run of equally filled sequences at once, so the plan has few rows however many
documents there are. Pieces then take their planned places by their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.batches import slices, texts_of
from runledger.llm.storage import shuffle_partitions, stored
from runledger.llm.tokens import UnitEncoder, merges_by_rank, words

CAPACITY = 2048
SEPARATOR = 0
# Ranks are counted in this many slices of a length at most, so that no length is one task.
RANK_SLICES = 32
_PIECES = "doc_id long, piece int, start long, length long, ids binary"
_RUNS = "length long, first_rank long, last_rank long, per_sequence long, first_sequence long, first_offset long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids (little-endian 32-bit, as binary).

    A document is its ids and then ``separator``; only longer ones are cut. A NULL text is an empty one and
    gives a piece of one token. Repeated rows each give their pieces. ``tokenizer`` must drop white space.
    """
    by_rank = merges_by_rank(tokenizer)
    end = np.array([separator], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder(tokenizer, words, by_rank)
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts_of(batch)), strict=True):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    rows.append((doc_id, piece, start // 4, len(part) // 4, part))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over counts per length; rows as in ``_RUNS``, ranks from 0, last rank exclusive.

    Sequences with the same room and history are one group. The fullest group that has room for the length
    takes as many pieces as fit into each of its sequences, one sequence after the other.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    sequences = 0

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit into {capacity}")
        rank, total = 0, counts[length]
        while rank < total:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, n = capacity, sequences, max(1, -(-(total - rank) // (capacity // length)))
                sequences += n
            each = min(room // length, total - rank)
            used = min(n, (total - rank) // each)
            runs.append((length, rank, rank + used * each, each, first, capacity - room))
            rank += used * each
            leave(room - each * length, first, used)
            leave(room, first + used, n - used)
    return runs


def place(pieces_: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length and any other columns but these two).

    Sequences are numbered from 0 and filled without gaps. ``pieces_`` is read three times and should be stored.
    """
    spark = pieces_.sparkSession
    counts = {r.length: r["count"] for r in pieces_.groupBy("length").count().collect()}
    runs = spark.createDataFrame(best_fit(counts, capacity), _RUNS).withColumnRenamed("length", "run_length")
    n = min(RANK_SLICES, shuffle_partitions(spark))
    sliced = pieces_.withColumn("rank_slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)))
    before = Window.partitionBy("slice_length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most capacity * RANK_SLICES rows.
    bases = (
        sliced.groupBy(F.col("length").alias("slice_length"), F.col("rank_slice").alias("slice"))
        .count()
        .select("slice_length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    )
    within = Window.partitionBy("length", "rank_slice").orderBy("doc_id", "piece")
    ranked = (
        sliced.withColumn("place_rank", F.row_number().over(within) - 1)
        .join(F.broadcast(bases), (F.col("length") == F.col("slice_length")) & (F.col("rank_slice") == F.col("slice")))
        .withColumn("place_rank", F.col("place_rank") + F.col("base"))
    )
    at = F.col("place_rank") - F.col("first_rank")
    fits = (F.col("length") == F.col("run_length")) & (F.col("place_rank") >= F.col("first_rank")) & (F.col("place_rank") < F.col("last_rank"))
    return ranked.join(F.broadcast(runs), fits).select(
        *pieces_.columns,
        (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + at % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """Pieces of all documents with their ids and places: doc_id, piece, start, length, ids, sequence_id, offset."""
    return place(stored(pieces(docs, tokenizer, capacity, separator), "pieces"), capacity)

"""Repeated runs of lines, found with a suffix array over line ids.

Every line is named by a hash, and only lines that occur more than once go on. The suffixes of the sequences of such lines
are sorted by prefix doubling: a suffix has the rank of its first line, then of its first two lines, four and so on, each
step ranking pairs of earlier ranks. Ranks are an offset within the suffixes that begin with the same line, so no global
order is needed, and pairs are counted before they are ranked. Suffixes that stay equal to their end are one entry.

Longest common prefixes of neighbouring entries come from the ranks of all steps, by descent. A pass over the entries in
order then gives for each the longest beginning that also occurs at an earlier place (its LCP interval holds an earlier
suffix). Those are the maximal repeated runs; their later copies are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.storage import free_name, shuffle_partitions, stored

# A repeated run is deleted if it has at least this many words.
LEAST_WORDS = 8
_PLACE = ["d", "l"]


def _lines(rows: DataFrame) -> DataFrame:
    """(d, doc_id, l, h, g, w) of every line: row, number in the text, two hashes, and words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    line = F.col("line")
    words = F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    return rows.select("d", "doc_id", F.posexplode(F.split(text, "\n")).alias("l", "line")).select(
        "d", "doc_id", "l", F.xxhash64(line).alias("h"), F.hash(line).alias("g"), words.alias("w")
    )


def _repeated(lines: DataFrame) -> DataFrame:
    """Lines that occur more than once, with the offset ``o`` of their class among all lines of the same hash."""
    counted = lines.groupBy("h", "g").agg(F.count("*").alias("n")).filter("n > 1")
    before = Window.partitionBy("h").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    classes = counted.select("h", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    found = lines.join(classes, ["h", "g"])
    return found.select("d", "doc_id", "l", "w", "h", "o", F.array("o").alias("steps"), F.lit(True).alias("open"))


def _doubled(ranks: DataFrame, reach: int) -> DataFrame:
    """Ranks by twice as many lines. Rows that are alone in their class, or end here, are not open any more."""
    along = Window.partitionBy("d").orderBy("l")
    goes_on = F.lead("l", reach).over(along) == F.col("l") + reach
    none = F.lit(-1).cast("long")
    paired = ranks.select(
        "*", F.coalesce(F.when(goes_on, F.lead("h", reach).over(along)), none).alias("h2"), F.coalesce(F.when(goes_on, F.lead("o", reach).over(along)), none).alias("o2")
    )
    pair = ["h", "o", "h2", "o2"]
    # A suffix that ends sorts before all that go on.
    before = Window.partitionBy("h", "o").orderBy(F.col("o2") >= 0, "h2", "o2").rowsBetween(Window.unboundedPreceding, -1)
    open_ = paired.filter("open").drop("open")
    named = open_.groupBy(*pair).agg(F.count("*").alias("n")).select(
        *pair, (F.col("o") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("new"), ((F.col("n") > 1) & (F.col("o2") >= 0)).alias("open")
    )
    moved = open_.join(named, pair).withColumn("o", F.col("new")).select("d", "doc_id", "l", "w", "h", "o", "steps", "open")
    both = moved.unionByName(ranks.filter("NOT open"))
    return both.withColumn("steps", F.concat("steps", F.array("o")))


def _common(entries: DataFrame, ranks: DataFrame, steps: int) -> DataFrame:
    """Entries (h, o, first) with ``lcp``, the lines they share with the entry before them of the same first line.

    Entries share the first line; from the widest step at which they are equal on, narrower ones are tried behind it.
    """
    order = Window.partitionBy("h").orderBy("o")
    last = entries.select("h", "o", "first", "steps", F.lag(F.struct("first", "steps")).over(order).alias("prior"))
    shared = F.size(F.filter(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.col("steps")[i] == F.col("prior.steps")[i]))
    # Equal at a step means equal at all narrower ones, so the count is the widest equal step plus one.
    pairs = stored(
        last.select("h", "o", "first", F.col("prior.first").alias("last"), shared.alias("equal")).withColumn(
            "lcp", F.when(F.col("last").isNotNull() & (F.col("equal") > 0), F.pow(F.lit(2), F.col("equal") - 1).cast("long")).otherwise(F.lit(0).cast("long"))
        ),
        "pairs",
    )
    for step in range(steps - 2, -1, -1):
        tried = pairs.filter(F.col("equal") - 1 > step)
        if tried.isEmpty():
            continue
        sides = tried.select("h", "o", "lcp", F.explode(F.array("first", "last")).alias("at")).select(
            F.col("h").alias("eh"), F.col("o").alias("eo"), F.col("at.d").alias("d"), (F.col("at.l") + F.col("lcp")).cast("int").alias("l")
        )
        found = sides.join(ranks.select(*_PLACE, F.struct("h", F.col("steps")[step].alias("o")).alias("class")), _PLACE)
        same = found.groupBy("eh", "eo").agg((F.count("*") == 2).alias("two"), (F.min("class") == F.max("class")).alias("one")).filter("two AND one")
        longer = same.select(F.col("eh").alias("h"), F.col("eo").alias("o"), F.lit(2**step).cast("long").alias("more"))
        pairs = stored(pairs.join(longer, ["h", "o"], "left").withColumn("lcp", F.col("lcp") + F.coalesce("more", F.lit(0))).drop("more"), "pairs")
    return pairs


def _longest_earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For entries in order: how many lines of each also occur at an earlier place. One stack per first line."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        h, o, run = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(o, pa.int64()), pa.array(run, pa.int64())], names=["h", "o", "run"])

    out: list[tuple] = []
    stack: list[list] = []  # [place, lcp with the entry below, o]
    current = None

    def close(place, lcp: int) -> int:
        """Takes entries off the stack that ``place`` decides; None stands for the end of the class."""
        while stack:
            top = stack[-1]
            if place is None or place < top[0]:
                out.append((current, top[2], max(top[1], lcp)))
                lcp = min(top[1], lcp)
            elif lcp <= top[1]:
                out.append((current, top[2], top[1]))
            else:
                break
            stack.pop()
        return lcp

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("h", "o", "doc", "d", "l", "lcp"))
        for h, o, doc, d, line, lcp in zip(*columns, strict=True):
            if h != current:
                close(None, 0)
                current = h
            place = (doc is not None, doc or 0, d, line)
            stack.append([place, close(place, lcp), o])
        yield done(out)
        out.clear()
    close(None, 0)
    yield done(out)


def _cut(least_words: int):
    """Deleted lines of each document, from its repeated lines in order."""

    def of(rows: pa.Table) -> pa.RecordBatch:
        d, line, run, w = (rows.column(c).to_numpy() for c in ("d", "l", "run", "w"))
        words = np.concatenate([[0], np.cumsum(w)])
        at = np.flatnonzero(run > 0)
        at = at[words[at + run[at]] - words[at] >= least_words]
        marks = np.zeros(len(d) + 1, np.int64)
        np.add.at(marks, at, 1)
        np.add.at(marks, at + run[at], -1)
        gone = marks.cumsum()[:-1] > 0
        return pa.RecordBatch.from_arrays([pa.array(d[gone]), pa.array(line[gone].astype(np.int32))], names=["d", "line"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < 20_000:
                continue
            d = held.column("d").to_numpy()
            whole = int(np.searchsorted(d, d[-1], "left"))
            if whole:
                yield of(held.slice(0, whole).combine_chunks())
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield of(held.combine_chunks())

    return run


def _deleted(lines: DataFrame, least_words: int) -> DataFrame:
    """(d, line) of every line to delete."""
    ranks = stored(_repeated(lines), "ranks")
    steps, reach = 1, 1
    while not ranks.filter("open").isEmpty():
        ranks = stored(_doubled(ranks, reach), "ranks")
        steps, reach = steps + 1, 2 * reach
    place = F.struct(F.col("doc_id").alias("doc"), "d", "l")
    entries = ranks.groupBy("h", "o").agg(F.min(place).alias("first"), F.first("steps").alias("steps"))
    pairs = _common(entries, ranks, steps)
    ordered = pairs.select("h", "o", "first.*", "lcp").repartition(shuffle_partitions(lines.sparkSession), "h").sortWithinPartitions("h", "o")
    runs = ordered.mapInArrow(_longest_earlier, "h long, o long, run long")
    firsts = pairs.select("h", "o", "first").join(runs, ["h", "o"])
    # Equal suffixes but the first occur before as a whole, to the end of their stretch of repeated lines.
    along = Window.partitionBy("d").orderBy("l")
    stretch = Window.partitionBy("d", "stretch")
    lefts = ranks.withColumn("stretch", F.col("l") - F.row_number().over(along)).withColumn("left", F.max("l").over(stretch) - F.col("l") + 1)
    known = lefts.join(firsts, ["h", "o"]).select(
        "d", "l", "w", F.when((F.col("first.d") == F.col("d")) & (F.col("first.l") == F.col("l")), F.col("run")).otherwise(F.col("left")).cast("long").alias("run")
    )
    in_order = known.repartition(shuffle_partitions(lines.sparkSession), "d").sortWithinPartitions("d", "l")
    return in_order.mapInArrow(_cut(least_words), "d long, line int")


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines and ``deleted`` (line numbers from 0, in order) for every row of ``docs``.

    Lines are what lies between line breaks. A line is deleted if it is in a run of lines with at least ``least_words`` words
    that also occurs at an earlier place; places are ordered by doc_id (NULL first), then row and line. The two
    occurrences may overlap. A NULL text is an empty one and has one empty line; runs of blank lines have no words and
    stay. A repeated row is a later copy of the first. Other columns are ignored.
    """
    numbered = docs.select(F.col("doc_id").cast("long"), "text").withColumn("d", F.monotonically_increasing_id())
    return _by_row(stored(_lines(numbered), "lines"), least_words).drop("d")


def _by_row(lines: DataFrame, least_words: int) -> DataFrame:
    deleted = _deleted(lines, least_words).groupBy("d").agg(F.sort_array(F.collect_list("line")).alias("deleted"))
    rows = lines.groupBy("d").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n_lines"))
    empty = F.array().cast("array<int>")
    return rows.join(deleted, "d", "left").select("d", "doc_id", "n_lines", F.coalesce("deleted", empty).alias("deleted"))


def drop_repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the deleted lines, all columns and rows kept; NULL texts stay NULL."""
    number = free_name(docs, "line_dedup_row")
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    lines = stored(_lines(numbered.select(F.col(number).alias("d"), F.col("doc_id").cast("long").alias("doc_id"), "text")), "lines")
    gone = free_name(docs, "line_dedup_deleted")
    cut = _by_row(lines, least_words).select(F.col("d").alias(number), F.col("deleted").alias(gone))
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(gone), i))
    return numbered.join(cut, number).withColumn("text", F.array_join(kept, "\n")).select(*docs.columns)

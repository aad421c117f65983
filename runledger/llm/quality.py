"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics of every document are taken once, in numpy over many texts together, and stored. Trees are fitted
on a bounded sample of labelled rows. They are flattened into arrays, level by level, so that scoring walks all
rows through a tree with a few array operations per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.batches import slices, texts_of
from runledger.llm.storage import stored
from runledger.llm.textbytes import Texts, span_hashes, spans, word_spans

# Labelled rows that the trees are fitted on, at most.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, LEAST, RIDGE = 64, 60, 4, 0.15, 8, 1.0
STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "long_words", "upper", "digits", "non_ascii", "line_breaks", "stops", "commas",
    "bars", "shouts", "marks", "symbols", "control", "marked_words", "distinct_words", "repeated_words", "most_frequent_word",
    "distinct_lines", "line_words",
]


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def statistics(texts: list[str]) -> np.ndarray:
    """A row of numbers per text, in the order of STATISTICS."""
    if not texts:
        return np.zeros((0, len(STATISTICS)))
    t = Texts.of(texts)
    data, n = t.data, len(texts)
    size = np.diff(t.starts) - 1
    kinds = np.zeros((8, 256), bool)
    for row, chars in enumerate((range(65, 91), range(48, 58), range(128, 256), b".", b",", b"|", b"!", b"#&%$*@^~<>{}[]=+\\_/")):
        kinds[row, list(chars)] = True
    upper, digits, wide, stops, commas, bars, shouts, marks = (t.per_text(kind[data]) for kind in kinds)
    starts, ends = word_spans(data)
    doc = np.searchsorted(t.starts, starts, "right") - 1
    words = np.bincount(doc, minlength=n)
    length = ends - starts
    word = span_hashes(data, starts, ends)
    odd = np.bincount(doc, weights=kinds[5:].any(0)[data[ends - 1]] if len(ends) else None, minlength=n)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((word, doc))
    change = np.ones(len(word), bool)
    change[1:] = (np.diff(word[order]) != 0) | (np.diff(doc[order]) != 0)
    distinct = np.bincount(doc[order][change], minlength=n)
    most = np.zeros(n, np.int64)
    firsts = np.flatnonzero(change)
    np.maximum.at(most, doc[order][change], np.diff(firsts, append=len(word)))
    line_starts, line_ends = spans(data != 10)
    line_doc = np.searchsorted(t.starts, line_starts, "right") - 1
    lines = np.bincount(line_doc, minlength=n)
    pairs = np.unique(np.stack([line_doc.astype(np.uint64), span_hashes(data, line_starts, line_ends)]), axis=1)
    columns = [
        np.log1p(size), np.log1p(words), _share(np.bincount(doc, weights=length, minlength=n), words),
        _share(np.bincount(doc, weights=length > 12, minlength=n), words), _share(upper, size), _share(digits, size), _share(wide, size),
        _share(t.per_text(data == 10) - 1, size), _share(stops, words), _share(commas, words), _share(bars, words), _share(shouts, words),
        _share(marks, words), _share(t.per_text((data > 32) & (data < 48)), size), _share(t.per_text((data < 9) | (data == 127)), size),
        _share(odd, words), _share(distinct, words), _share(np.bincount(doc, weights=again, minlength=n), words), _share(most, words),
        _share(np.bincount(pairs[0].astype(np.int64), minlength=n), lines), _share(words, lines),
    ]
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """Complete binary trees of one depth; node i of a tree has the children 2i + 1 and 2i + 2."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        raw = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            raw += value[node - len(feature)]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosts trees on the logistic loss; splits are searched in histograms of at most BINS quantile bins.

    Without rows of both labels the score is the share of label 1, or a half without any row.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    nodes, leaves = 2**DEPTH - 1, 2**DEPTH
    trees = Trees(float(np.log(share / (1 - share))), np.zeros((0, nodes), int), np.zeros((0, nodes)), np.zeros((0, leaves)))
    if len(set(y.tolist())) < 2:
        return trees
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])) for column in x.T]
    bins = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
    width = x.shape[1] * BINS
    at = bins + np.arange(x.shape[1]) * BINS
    raw = np.full(len(y), trees.start)
    grown = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        gradient, hessian = y - p, p * (1 - p)
        feature, threshold = np.zeros(nodes, int), np.full(nodes, np.inf)
        node = np.zeros(len(y), int)
        for i in range(nodes):
            own = np.flatnonzero(node == i)
            if len(own) >= 2 * LEAST:
                cells = at[own].ravel()
                g, h, c = (
                    np.bincount(cells, weights=w, minlength=width).reshape(-1, BINS).cumsum(1)
                    for w in (np.repeat(v[own], x.shape[1]) for v in (gradient, hessian, np.ones(len(y))))
                )
                total_g, total_h, total_c = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
                gain[(c < LEAST) | (total_c - c < LEAST)] = -1
                best = int(gain.argmax())
                f, b = divmod(best, BINS)
                if gain.flat[best] > 1e-6 and b < len(cuts[f]):
                    feature[i], threshold[i] = f, cuts[f][b]
            node[own] = 2 * i + 1 + (x[own, feature[i]] > threshold[i])
        leaf = node - nodes
        value = RATE * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, hessian, leaves) + RIDGE)
        raw += value[leaf]
        grown.append((feature, threshold, value))
    return Trees(trees.start, *(np.stack(part) for part in zip(*grown, strict=True)))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and an array ``x`` of the statistics of every row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            x = statistics(texts_of(part))
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), flat], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x array<double>")


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(label_id, y) of the documents to learn from: without held-out ones and NULLs; the largest of several labels."""
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("y")).filter("label_id IS NOT NULL AND y IS NOT NULL")
    return known.filter(~is_held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("y").alias("y"))


def sampled(known: DataFrame, most: int) -> DataFrame:
    """At most ``most`` labelled documents in the order of a hash, so the sample is the same at every run."""
    return known.orderBy(F.xxhash64("label_id"), "label_id").limit(most)


def training_rows(rows: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """The rows of at most ``most`` sampled documents with their labels; these are few enough to be broadcast."""
    joined = rows.join(F.broadcast(known), rows["doc_id"] == known["label_id"]).drop("label_id")
    return joined.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)


def _fitted(rows: DataFrame, labels: DataFrame, sample: int) -> Trees:
    learned = training_rows(rows, sampled(known_labels(labels, "quality"), sample), sample).select("x", "y").toPandas()
    x = np.stack(learned.x.to_list()) if len(learned) else np.zeros((0, len(STATISTICS)))
    return fit(x, learned.y.to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out and score (probability of ``labels.quality`` = 1) for every row of ``docs``.

    Only the text is scored; NULL is an empty text, and empty texts get the score of their statistics. Rows that
    repeat get the same score each. Labels of held-out rows, NULL labels and labels without a document teach nothing;
    of several labels of a document the largest counts. Other columns are ignored.
    """
    rows = stored(with_statistics(docs), "statistics")
    trees = _fitted(rows, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(trees.score(x), pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score")


def drop_poor(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all columns; trees are fitted as in ``quality_scores``.

    Statistics are taken again where the rows are read, which spares a shuffle of the texts.
    """
    trees = _fitted(stored(with_statistics(docs), "statistics"), labels, sample)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, at)):
            good = trees.score(statistics([x or "" for x in part.column(at).to_pylist()])) >= least
            yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)

"""Toxicity by compression distance.

One zstandard dictionary is trained, on windows of ordinary text. The toxic one is not: it is the list of the beginnings of
words that are much commoner in toxic documents, joined as they are. Each window of a few words is compressed with the
ordinary dictionary alone and with the toxic list in front of it; how many bytes the list saves is the window's distance.
A toxic document saves nothing if each of its words is rare among toxic documents, or if only phrases of common words
make it toxic. A dictionary trained on windows of toxic text scores far worse (figures in the README). Distances are turned into evidence by how often they occur in toxic and in other documents, and a document's evidence into a
calibrated probability. Dictionaries and calibration learn from separate halves of a bounded sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.batches import slices, texts_of
from runledger.llm.quality import is_held_out, known_labels, sampled, training_rows

# Labelled rows to learn from, at most, of which the toxic ones come first up to a third.
SAMPLE = 12_000
WINDOW, LEVEL, ORDINARY_BYTES, TOXIC_BYTES = 8, 9, 32_000, 16_000
SHORTEST, LONGEST, ENRICHED = 5, 12, 15.0
LEAST, LEAST_SHARE = 5, 0.012
# Distances from 0 to SAVED bytes are told apart.
SAVED = 15


def windows(text: str) -> list[bytes]:
    """Runs of WINDOW lower-cased words; one of a single space for a text without words."""
    words = text.lower().split()
    return [f" {' '.join(words[i : i + WINDOW])} ".encode("utf-8", "replace") for i in range(0, len(words), WINDOW)] or [b" "]


def _train(size: int, samples: list[bytes]) -> bytes:
    """The content of a dictionary trained by zstandard; the samples themselves where they are too few for that."""
    import zstandard

    joined = b"".join(samples)
    if len(joined) > 4 * size:
        try:
            trained = zstandard.train_dictionary(size, samples).as_bytes()
            # Its entropy tables would favour one side; both sides use plain content.
            return trained[min(len(trained) // 2, 1024) :]
        except zstandard.ZstdError:
            pass
    return joined[-size:]


def _pieces(words: set[str], size: int) -> set[str]:
    return {f" {word} "[:size] for word in words if len(word) + 2 >= size}


def toxic_pieces(toxic: list[set[str]], ordinary: list[set[str]]) -> list[str]:
    """Beginnings of words that are ENRICHED times commoner in toxic documents, weakest first.

    Longer beginnings are only counted where the shorter ones are frequent, which bounds the counters.
    """
    least = max(LEAST, round(LEAST_SHARE * len(toxic)))
    found: dict[str, float] = {}
    frequent: set[str] | None = None
    for size in range(SHORTEST, LONGEST + 1):
        counts = Counter(p for words in toxic for p in _pieces(words, size) if frequent is None or p[:-1] in frequent)
        frequent = {p for p, n in counts.items() if n >= least}
        others = Counter(p for words in ordinary for p in _pieces(words, size) if p in frequent)
        for p in frequent:
            ratio = (counts[p] / len(toxic) + 1e-3) / (others[p] / max(1, len(ordinary)) + 1e-3)
            if ratio > ENRICHED:
                found[p] = ratio
    chosen: list[str] = []
    text = ""
    for p in sorted(found, key=lambda p: (-len(p), p)):
        if p not in text:
            chosen.append(p)
            text += p
    return sorted(chosen, key=lambda p: (found[p], p))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    evidence: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self._compress = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_compress"}

    def __setstate__(self, state):
        self.__dict__.update(state, _compress=None)

    def distances(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes saved in every window, and where each text's windows begin and end."""
        import zstandard as z

        if self._compress is None:
            self._compress = [
                z.ZstdCompressor(
                    level=LEVEL,
                    dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT),
                    write_content_size=False, write_checksum=False, write_dict_id=False,
                ).compress
                for content in (self.ordinary or b"        ", (self.toxic + self.ordinary) or b"        ")
            ]
        plain, both = self._compress
        cut = [windows(text) for text in texts]
        saved = np.array([len(plain(w)) - len(both(w)) for of in cut for w in of], np.int64)
        return saved.clip(0, SAVED), np.cumsum([0, *map(len, cut)])

    def features(self, texts: list[str]) -> np.ndarray:
        saved, bounds = self.distances(texts)
        if not texts:
            return np.zeros((0, 6))
        n = np.diff(bounds)
        weight = self.evidence[saved]
        total, most = np.add.reduceat(weight, bounds[:-1]), np.maximum.reduceat(weight, bounds[:-1])
        hits = np.add.reduceat((saved >= 4).astype(float), bounds[:-1])
        return np.stack([np.ones(len(n)), total, most, np.log1p(n), hits / n * 10, np.log1p(hits)], axis=1)

    def score(self, texts: list[str]) -> np.ndarray:
        raw = (self.features(texts) @ self.weights).clip(-30, 30)
        return 1 / (1 + np.exp(-raw))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """Learns from labelled texts in any order that does not depend on the label.

    With fewer than four texts of either label the score is the share of label 1.
    """
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    model = Model(b"", b"", np.zeros(SAVED + 1), np.array([np.log(share / (1 - share)), 0, 0, 0, 0, 0]))
    if min(labels.sum(), len(labels) - labels.sum()) < 4:
        return model
    rank = np.zeros(len(labels), int)
    for label in (0, 1):
        rank[labels == label] = np.arange((labels == label).sum())
    first = rank % 2 == 0
    words = [set(t.lower().split()) for t, own in zip(texts, first, strict=True) if own]
    learned = labels[first] == 1
    pieces = toxic_pieces([w for w, tox in zip(words, learned, strict=True) if tox], [w for w, tox in zip(words, learned, strict=True) if not tox])
    ordinary = [w for t, own, y in zip(texts, first, labels, strict=True) if own and not y for w in windows(t)]
    model.ordinary = _train(ORDINARY_BYTES, ordinary[:: max(1, len(ordinary) // 60_000)])
    model.toxic = _train(TOXIC_BYTES, [p.encode() for p in pieces])
    rest = [t for t, own in zip(texts, first, strict=True) if not own]
    y = labels[~first].astype(float)
    saved, bounds = model.distances(rest)
    of_toxic = np.repeat(y == 1, np.diff(bounds))
    seen = np.stack([np.bincount(saved[of_toxic == t], minlength=SAVED + 1) + 0.5 for t in (True, False)])
    rates = seen / seen.sum(1, keepdims=True)
    # Saving more is never weaker evidence, and saving nothing is none.
    model.evidence = np.maximum.accumulate(np.log(rates[0] / rates[1]).clip(0, 8))
    model.evidence[0] = 0
    model.weights = _logistic(model.features(rest), y)
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out and score (probability of ``labels.toxic`` = 1) for every row of ``docs``.

    Only the text is scored, all of it; NULL is an empty text, and empty texts get the score of a text without evidence.
    Rows that repeat get the same score each. Labels of held-out rows, NULL labels and labels without a document teach
    nothing; of several labels of a document the largest counts. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = known_labels(labels, "toxic")
    few = sampled(known.filter("y = 1"), sample // 3).unionByName(sampled(known.filter("y = 0"), sample - sample // 3))
    learned = training_rows(rows, few, sample).select("text", "y").toPandas()
    model = fit(learned.text.to_list(), learned.y.to_numpy(int))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            scores = pa.array(model.score(texts_of(part)), pa.float64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), scores], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score")

"""Byte-level BPE encoding and decoding of whole texts, long ones by tree concatenation.

A long text is cut into leaves, which tasks encode independently. Encodings are then joined in pairs, as in
a tree. At each join a window around it is encoded again and grows until the tokens that it shares with the
left part and those that it shares with the right part agree exactly; everything outside stays as it is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.batches import slices, texts_of
from runledger.llm.storage import shuffle_partitions
from runledger.llm.tokens import UnitEncoder, byte_table, merges_by_rank, spaced_words

# Characters of a leaf, and of a window's first half.
LEAF, WINDOW = 16_384, 128
# Neighbouring tokens that must agree on each side of a join.
AGREE = 4
_IDS = "doc_id long, ids binary"


class Decoder:
    """Bytes of each id of a byte-level vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        table = byte_table()
        pieces = {i: bytes(table[c] for c in token) for token, i in spec["model"]["vocab"].items()}
        pieces |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]

    def raw(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def text(self, ids: bytes) -> str:
        return self.raw(ids).decode("utf-8", "replace")


class Joiner:
    """Joins the encodings of neighbouring parts of one text."""

    def __init__(self, encoder: UnitEncoder, decoder: Decoder):
        self.encoder = encoder
        self.sizes = np.array([len(p) for p in decoder.pieces], np.int64)

    def _ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.sizes[ids])

    def _encode(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(self.encoder.encode([raw.decode("utf-8")])[0], "<u4")

    def join(self, left: np.ndarray, right: np.ndarray, raw: bytes, start: int, at: int, stop: int) -> np.ndarray:
        """The encoding of ``raw[start:stop]``, given those of its parts before and from ``at``."""
        if at == start or at == stop:
            return right if at == start else left
        left_ends, right_ends = start + self._ends(left), at + self._ends(right)
        half = WINDOW
        while True:
            a, b = max(start, at - half), min(stop, at + half)
            while a > start and raw[a] & 0xC0 == 0x80:  # never inside a character
                a -= 1
            while b < stop and raw[b] & 0xC0 == 0x80:
                b += 1
            window = self._encode(raw[a:b])
            ends = a + self._ends(window)
            # Counts of whole tokens from the left part, and from the right part, that can stay.
            keep = 0 if a == start else self._shared(left, left_ends, window, ends, a, at, first=False)
            take = 0 if b == stop else self._shared(window, ends, right, right_ends, at, b, first=True)
            if keep is not None and take is not None:
                lo, to = (keep, left_ends[keep - 1]) if keep else (0, start)
                at_right = len(right) - take
                to_right = right_ends[at_right - 1] if take else stop
                w0 = 0 if to == a else int(np.searchsorted(ends, to)) + 1
                w1 = int(np.searchsorted(ends, to_right)) + 1
                if to <= to_right:
                    return np.concatenate([left[:lo], window[w0:w1], right[at_right:]])
            if a == start and b == stop:
                return window
            half *= 2

    @staticmethod
    def _shared(one: np.ndarray, one_ends: np.ndarray, two: np.ndarray, two_ends: np.ndarray, low: int, high: int, first: bool) -> int | None:
        """Where AGREE neighbouring tokens of both encodings agree strictly between ``low`` and ``high``.

        Not counting the tokens next to either edge, as an edge may cut them. With ``first`` the tokens of
        ``two`` from there on are counted, otherwise those of ``one`` up to there; None if they never agree.
        """
        common, i, j = np.intersect1d(one_ends, two_ends, assume_unique=True, return_indices=True)
        inside = (common > low) & (common < high)
        i, j = i[inside], j[inside]
        if len(i) <= AGREE:
            return None
        same = (one[i] == two[j]) & (i > 0) & (j > 0)
        same[1:] &= (np.diff(i) == 1) & (np.diff(j) == 1)
        same[0] = False
        run = np.convolve(same, np.ones(AGREE, int))[: len(same)] == AGREE
        places = np.flatnonzero(run)
        if not len(places):
            return None
        # The middle of the agreeing tokens, so that neighbours on either side are in a checked encoding.
        place = places[0] if first else places[-1]
        place -= AGREE // 2
        return len(two) - int(j[place]) - 1 if first else int(i[place]) + 1


def tree_join(joiner: Joiner, raw: bytes, parts: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Joins (start, stop, ids) of neighbouring parts in pairs until one encoding is left."""
    while len(parts) > 1:
        joined = []
        for (s, m, left), (_, e, right) in zip(parts[::2], parts[1::2], strict=False):
            joined.append((s, e, joiner.join(left, right, raw, s, m, e)))
        parts = joined + parts[len(joined) * 2 :]
    return parts[0][2]


def leaf_bounds(text: str, leaf: int = LEAF) -> list[int]:
    """Halves of halves of a text until none is longer than ``leaf`` characters."""
    n = 1
    while -(-len(text) // n) > leaf:
        n *= 2
    return [len(text) * i // n for i in range(n + 1)]


def _batch(doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])


def encode(docs: DataFrame, tokenizer: str, leaf: int = LEAF) -> DataFrame:
    """Ids of every row's text: doc_id, ids (little-endian 32-bit, as binary).

    The ids are those of the tokenizers library without added special tokens; their strings inside a text are
    taken as the library takes them. A NULL text is an empty one and has no ids. Rows that repeat a doc_id
    stay apart. Other columns are ignored.
    """

    by_rank = merges_by_rank(tokenizer)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder(tokenizer, spaced_words, by_rank)
        for part in (part for batch in batches for part in slices(batch)):
            yield _batch(part.column("doc_id").to_pylist(), encoder.encode(texts_of(part)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            rows = []
            for doc_id, row, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                bounds = leaf_bounds(text, leaf)
                rows += [(doc_id, row, i, text[a:b]) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "row", "leaf", "text"])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = UnitEncoder(tokenizer, spaced_words, by_rank)
        for part in (part for batch in batches for part in slices(batch)):
            yield part.append_column("ids", pa.array(encoder.encode(texts_of(part)), pa.binary()))

    tools: list = []

    def join_leaves(rows: pd.DataFrame) -> pd.DataFrame:
        if not tools:
            decoder = Decoder(tokenizer)
            tools.append(Joiner(UnitEncoder(tokenizer, spaced_words, by_rank), decoder))
        rows = rows.sort_values("leaf")
        raws = [text.encode() for text in rows.text]
        ends = np.cumsum([len(x) for x in raws]).tolist()
        parts = [(b - len(x), b, np.frombuffer(ids, "<u4")) for x, b, ids in zip(raws, ends, rows.ids, strict=True)]
        ids = tree_join(tools[0], b"".join(raws), parts)
        return pd.DataFrame({"doc_id": rows.doc_id.iloc[:1], "ids": [ids.astype("<u4").tobytes()]})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    short = rows.filter(F.length("text") <= leaf).mapInArrow(whole, _IDS)
    n = shuffle_partitions(docs.sparkSession)
    leaves = (
        rows.filter(F.length("text") > leaf)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(cut, "doc_id long, row long, leaf int, text string")
        .repartition(n, "doc_id", "row", "leaf")
        .mapInArrow(encode_leaves, "doc_id long, row long, leaf int, text string, ids binary")
    )
    return short.unionByName(leaves.groupBy("doc_id", "row").applyInPandas(join_leaves, _IDS))


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """Texts of encoded rows: doc_id, ids, text. Bytes that are no UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(tokenizer)
        for part in (part for batch in batches for part in slices(batch, "ids")):
            texts = [decoder.text(ids) for ids in part.column("ids").to_pylist()]
            yield part.append_column("text", pa.array(texts, pa.string()))

    return encoded.select("doc_id", "ids").mapInArrow(run, f"{_IDS}, text string")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()

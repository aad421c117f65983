"""Alignment of two tokenizations of the same texts, as an Arrow pipeline inside tasks and counts merged by Spark.

A task flattens the token lists of its documents with the index of the document that each token belongs to, and sums
token sizes up within each document. An Acero hash join on (document, end) finds the ends that both tokenizations share;
these cut the tokens into groups, and a second join on the group pairs the tokens. ``Table.group_by`` counts the pairs of
each document and then, per task, the documents of each pair; Spark adds the counts of all tasks up.

A document's own pairs then look up their corpus-wide counts: the commonest pairs, a list of bounded length, inside the task, all
others in a join on the pair, of which none is common.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.batches import slices, texts_of
from runledger.llm.storage import stored
from runledger.llm.tokens import LONGEST, REMEMBERED, UnitEncoder, byte_table, merges_by_rank, spaced_words

# Pairs that a task looks up itself, at most; links made at a time; different pairs that a task holds before it reports them.
COMMON, LINKS, HELD = 200_000, 1_000_000, 1_000_000
# Bytes of text that are aligned at a time; links of a group from which on its equal tokens are counted before they meet.
PART, LARGE = 1_000_000, 64
# Pairs of one document in a row.
ROW_PAIRS = 1_000_000
_SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_BREAK = re.compile(r"(?<=[^ ])(?= )")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


class SpacedEncoder(UnitEncoder):
    """Encodes a text with a space before it; strings of special tokens are plain text."""

    def __init__(self, path: str, by_rank: bool):
        super().__init__(path, spaced_words, by_rank)
        self.tokenizer.encode_special_tokens = True

    def _plain(self, text: str) -> bool:
        # The space in front begins the first unit as any other space does.
        return super()._plain(text[1:])

    def spaced(self, texts: list[str]) -> list[bytes]:
        return self.encode([" " + text for text in texts])


class PieceEncoder:
    """Encodes texts with sentencepiece, each different unit once.

    No piece of the model holds a space after another character, so no merge reaches over the place before a space.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.cuts = not any(_SPACE in name.lstrip(_SPACE) for name in names)
        self.lone = np.array([self.model.piece_to_id(_SPACE)], "<u4").tobytes()
        self.known: dict[str, bytes] = {}

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        return {u: np.array(ids, "<u4").tobytes() for u, ids in zip(units, self.model.encode(units, num_threads=1), strict=True)}

    def _units(self, text: str) -> list[str]:
        """Units without the space before each, which the model adds itself."""
        if not self.cuts or not text:
            return [text]
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        first, *others = _BREAK.split(text)
        return [first, *(u[1:] for u in others)]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self._units(text) for text in texts]
        new = {u for units in parts for u in units}.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = {u for units in parts for u in units}
        self.known.update(self._learn([u for u in new if len(u) <= LONGEST]))
        found = self.known | self._learn([u for u in new if len(u) > LONGEST])
        # A unit of the space alone is a lone space, an empty text has no unit.
        found[""] = self.lone
        return [b"".join(map(found.__getitem__, units)) if text else b"" for text, units in zip(texts, parts, strict=True)]


def byte_tokens(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    from tokenizers import Tokenizer

    vocabulary, table = Tokenizer.from_file(path).get_vocab(with_added_tokens=True), byte_table()
    tokens = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        tokens[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    return tokens


def piece_tokens(path: str) -> list[bytes]:
    """The bytes of each piece: U+2581 is a space, <0xHH> a byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    found = [_BYTE.fullmatch(name) for name in names]
    return [bytes([int(m[1], 16)]) if m else name.replace(_SPACE, " ").encode() for m, name in zip(found, names, strict=True)]


@cache
def _tools(a_path: str, b_path: str, by_rank: bool):
    """Encoders and the bytes, sizes and decimal names of all ids, once per worker."""
    tokens = byte_tokens(a_path), piece_tokens(b_path)
    names = pa.array(map(str, range(max(map(len, tokens)))))
    return SpacedEncoder(a_path, by_rank), PieceEncoder(b_path), [pa.array(t, pa.binary()) for t in tokens], names


def _lists(ids: list[bytes]) -> pa.ListArray:
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int64)))


def _ends(lists: pa.ListArray, tokens: pa.Array) -> pa.Table:
    """Token ids with their document, and the document and the token's end within it as one number."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    size = pc.binary_length(tokens).take(ids).cast(pa.int64())
    upto = pc.cumulative_sum(size).to_numpy(zero_copy_only=False)
    at = doc.to_numpy(zero_copy_only=False)
    # Sums restart with each document.
    first = np.searchsorted(at, np.arange(len(lists)))
    before = np.concatenate([[0], upto])[first]
    end = (at.astype(np.int64) << 40) + upto - before[at]
    return pa.table({"id": ids, "doc": doc, "end": end})


def _digests(a: pa.Table, b: pa.Table, group_a: np.ndarray, group_b: np.ndarray, n_groups: int, n_docs: int, names: pa.Array) -> list[str]:
    """Digests of each document's groups as text."""
    in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    upto_a, upto_b = np.cumsum(in_a), np.cumsum(in_b)
    # The tokens of A of a group come before those of B.
    place_a = np.arange(len(group_a)) + (upto_b - in_b)[group_a]
    place_b = np.arange(len(group_b)) + upto_a[group_b]
    n = len(place_a) + len(place_b)
    ids, mark, doc = np.zeros(n, np.int64), np.zeros(n, np.int8), np.zeros(n, np.int64)
    ids[place_a], ids[place_b] = a["id"].to_numpy(), b["id"].to_numpy()
    doc[place_a], doc[place_b] = a["doc"].to_numpy(), b["doc"].to_numpy()
    mark[upto_a + upto_b - in_b - 1], mark[upto_a + upto_b - 1] = 1, 2
    counts = np.bincount(doc, minlength=n_docs)
    last = np.cumsum(counts)
    mark[last[counts > 0] - 1] = 3
    written = pc.binary_join_element_wise(names.take(pa.array(ids)), pa.array([",", "|", ";", ""]).take(pa.array(mark)), "")
    bounds = pa.array(np.concatenate([[0], last]).astype(np.int64))
    texts = pc.binary_join(pa.LargeListArray.from_arrays(bounds, written), "")
    return [hashlib.sha256(text.as_buffer()).hexdigest() if text.is_valid and len(text.as_buffer() or b"") else "" for text in texts]


def _numbered(keys: pa.Array, values: pa.Array) -> pa.Table:
    """Sums of ``values`` per different key."""
    return pa.table({"key": keys, "n": values}).group_by("key", use_threads=False).aggregate([("n", "sum")]).select(["key", "n_sum"])


def _occurring(group: np.ndarray, ids: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and number of occurrences in it; equal tokens are counted together in large groups only."""
    alone = ~large[group]
    counted = _numbered(pa.array(group[~alone] << 32 | ids[~alone]), pa.array(np.ones(int((~alone).sum()), np.int64)))
    keys, n = counted["key"].to_numpy(), counted["n_sum"].to_numpy()
    return (
        np.concatenate([group[alone], keys >> 32]), np.concatenate([ids[alone], keys & 0xFFFFFFFF]), np.concatenate([np.ones(int(alone.sum()), np.int64), n])
    )


def _pairs(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, doc_of: np.ndarray, base: int) -> pa.Table:
    """How often each document links each pair of ids, from the ids and groups of both sides; in order of document and pair."""
    n = len(doc_of)
    large = np.bincount(group_a, minlength=n) * np.bincount(group_b, minlength=n) > LARGE
    of_a, of_b = _occurring(group_a, a, large), _occurring(group_b, b, large)
    left, right = (pa.table(dict(zip(names, of, strict=True))) for names, of in ((("group", "a", "in_a"), of_a), (("group", "b", "in_b"), of_b)))
    # A block of tokens of A makes a bounded number of pairs, however many tokens a group has.
    width = np.bincount(of_b[0], minlength=n)[of_a[0]]
    cuts = np.searchsorted(np.cumsum(width), np.arange(LINKS, int(width.sum()) + LINKS, LINKS), "right")
    found, start = [], 0
    for cut in np.maximum.accumulate(np.maximum(cuts, 1)):
        if cut > start:
            made = left.slice(start, cut - start).join(right, "group", join_type="inner", use_threads=False)
            key = doc_of[made["group"].to_numpy()] * (base << 20) + made["a"].to_numpy() * base + made["b"].to_numpy()
            found.append(_numbered(pa.array(key), pc.multiply(made["in_a"], made["in_b"])))
            start = cut
    whole = pa.concat_tables(found)
    whole = (whole if len(found) == 1 else _numbered(whole["key"], whole["n_sum"])).sort_by("key")
    key = whole["key"].to_numpy()
    return pa.table({"doc": pa.array(key // (base << 20)), "pair": pa.array(key % (base << 20)), "times": whole["n_sum"]})


def align(a_ids: list[bytes], b_ids: list[bytes], texts: list[str], tokens: list[pa.Array], names: pa.Array) -> tuple[dict[str, np.ndarray], list[str], pa.Table]:
    """Counts and digests of each text, and the pairs (doc, pair, times) in order. Ids are little-endian unsigned 32-bit."""
    lists = [_lists(ids) for ids in (a_ids, b_ids)]
    whole = pa.array([b" " + t.encode() for t in texts], pa.binary())
    usable = pa.array([t != "" for t in texts])
    for own, known in zip(lists, tokens, strict=True):
        joined = pc.binary_join(pa.ListArray.from_arrays(own.offsets, known.take(own.values)), b"")
        usable = pc.and_(usable, pc.equal(joined, whole))
    kept = np.flatnonzero(usable.to_numpy(zero_copy_only=False))
    counts, digests = {name: np.zeros(len(texts), np.int64) for name in _COUNTS}, [""] * len(texts)
    empty = pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "times": pa.array([], pa.int64())})
    if not len(kept):
        return counts, digests, empty
    a, b = (_ends(own.take(pa.array(kept)), known) for own, known in zip(lists, tokens, strict=True))
    shared = a.select(["end"]).join(b.select(["end"]), "end", join_type="inner", use_threads=False)["end"].to_numpy()
    shared = np.sort(shared)
    group_a, group_b = (np.searchsorted(shared, t["end"].to_numpy()) for t in (a, b))
    for name, docs in (("n_a", a["doc"]), ("n_b", b["doc"]), ("n_groups", shared >> 40)):
        counts[name][kept] = np.bincount(np.asarray(docs), minlength=len(kept))
    for i, digest in zip(kept, _digests(a, b, group_a, group_b, len(shared), len(kept), names), strict=True):
        digests[i] = digest
    pairs = _pairs(a["id"].to_numpy(), group_a, b["id"].to_numpy(), group_b, shared >> 40, len(tokens[1]))
    doc = pairs["doc"].to_numpy()
    counts["n_links"][kept] = np.bincount(doc, pairs["times"].to_numpy(), len(kept)).astype(np.int64)
    return counts, digests, pairs.set_column(0, "doc", pa.array(kept[doc]))


def _aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row per document with counts, digest and its pairs; further rows of the same ``row`` hold pairs that are too many for one."""
    by_rank = merges_by_rank(a_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, tokens, names = _tools(a_path, b_path, by_rank)
        for part in (part for batch in batches for part in slices(batch, most=PART)):
            texts = texts_of(part)
            counts, digests, pairs = align(a.spaced(texts), b.encode(texts), texts, tokens, names)
            n = np.bincount(pairs["doc"].to_numpy(), minlength=len(texts))
            extra = np.maximum(-(-n // ROW_PAIRS), 1)
            of = np.repeat(np.arange(len(texts)), extra)
            first = np.concatenate([[True], of[1:] != of[:-1]])
            sizes = np.full(len(of), ROW_PAIRS)
            ends = np.append(first[1:], True)
            sizes[ends] = n - (extra - 1) * ROW_PAIRS
            bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            rows, ids = (part.column(c).take(pa.array(of)) for c in ("row", "doc_id"))
            own = [pa.array(np.where(first, counts[name][of], 0)) for name in _COUNTS]
            listed = [pa.ListArray.from_arrays(bounds, pairs[c].combine_chunks()) for c in ("pair", "times")]
            digest = pa.array([digests[i] if f else None for i, f in zip(of, first, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([rows, ids, *own, digest, *listed], names=["row", "doc_id", *_COUNTS, "groups_sha256", "pairs", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, _ROWS)


def _flat(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False)


def _counted(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
        held = [schema.empty_table()]
        added = 0

        def total() -> pa.Table:
            return pa.concat_tables(held).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])

        for batch in batches:
            pairs = pc.list_flatten(batch.column("pairs"))
            held.append(pa.table({"pair": pairs, "n": pa.array(np.ones(len(pairs), np.int64))}))
            added += len(pairs)
            if added > HELD:
                held, added = [total()], 0
                if held[0].num_rows > HELD:
                    yield from held[0].to_batches()
                    held = [schema.empty_table()]
        yield from total().to_batches()

    return aligned.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _looked_up(aligned: DataFrame, common: np.ndarray, n: np.ndarray, best: np.ndarray) -> DataFrame:
    """Of each row the sums over its common pairs, with ``rare``, the pairs (and their times) that are not in ``common``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times, row = _flat(lists), _flat(batch.column("times")), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(common, pairs), max(len(common) - 1, 0))
            found = common[at] == pairs if len(common) else np.zeros(len(pairs), bool)
            total, top = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(total, row[found], times[found] * n[at[found]])
            np.add.at(top, row[found], times[found] * best[at[found]])
            bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~found], minlength=batch.num_rows))]).astype(np.int32))
            rare = pa.StructArray.from_arrays([pa.array(pairs[~found], pa.int64()), pa.array(times[~found], pa.int64())], names=["pair", "times"])
            kept = [batch.column(c) for c in ("row", "doc_id", *_COUNTS, "groups_sha256")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(top), pa.array(total), pa.ListArray.from_arrays(bounds, rare)],
                names=["row", "doc_id", *_COUNTS, "groups_sha256", "n_best", "count_sum", "rare"],
            )

    schema = _ROWS.replace("pairs array<long>, times array<long>", "n_best long, count_sum long, rare array<struct<pair: long, times: long>>")
    return aligned.mapInArrow(run, schema)


def token_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 for every row of ``docs``.

    A is the byte-level tokenizer in ``a_path`` on a space and the text, B the sentencepiece model in ``b_path`` on the text.
    Groups are what lies between byte offsets at which tokens of both end; all tokens of A and B of a group are linked, each
    occurrence with each. A pair of ids counts once for every row that links it; ``count_sum`` adds the counts of all links
    up and ``n_best`` counts the links with the highest count of their id of A. Rows whose text is NULL, empty, or not what both
    tokenizations spell (one with U+2581, for instance) have no tokens: zeros and an empty digest. Rows that repeat a doc_id
    are rows of their own; doc_id may be NULL; other columns are ignored. An empty table gives an empty result.
    """
    aligned = stored(_aligned(docs, a_path, b_path), "aligned")
    counts = stored(_counted(aligned), "counts")
    base = len(piece_tokens(b_path))
    of_a = F.floor(F.col("pair") / base)
    # One row per id of A, no more than its vocabulary has.
    highest = counts.groupBy(of_a.alias("a")).agg(F.max("n").alias("highest"))
    counts = counts.withColumn("a", of_a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).cast("long").alias("best"))
    common = counts.orderBy(F.desc("n"), "pair").limit(COMMON).toPandas().sort_values("pair")
    found = stored(_looked_up(aligned, *(common[c].to_numpy(np.int64) for c in ("pair", "n", "best"))), "found")
    rare = found.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.times").join(counts, "pair")
    sums = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    both = found.drop("rare").unionByName(sums, allowMissingColumns=True)
    summed = both.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in (*_COUNTS, "n_best", "count_sum")), F.max("groups_sha256").alias("groups_sha256")
    )
    return summed.drop("row")

"""Prefix trie of conversations, built by the van Emde Boas recursion.

Every sequence of turns is cut at half of the trie's height. A cut prefix is named by its digest; equal prefixes have one
name, so the upper trie is the trie of the distinct cut prefixes, and below each name hangs a lower trie of what follows it.
Upper and lower tries are pieces of half the height and are cut again, all pieces of a height in one job, until a piece is a
single turn. Pieces that became equal are merged at every step, with their numbers of conversations added up.

Totals are grafted upward in the same steps: pieces of a height know their own subtree totals; for twice the height the total
of the forest below each cut prefix is added to the nodes on the path from the upper trie's root down to it.
A conversation is one row of 16 bytes and a word count per turn; texts are read once, where their digests are taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.storage import stored
from runledger.operators.skew import spread_join

ROOT = bytes(16)
# Branches leave a conversation of each family of so many ids; ends are digested in blocks of 2**BLOCK ids.
FAMILY, BLOCK = 20, 12
_WORD = r"[^\x20\x09-\x0D]+"
_NONE = hashlib.sha256().hexdigest()


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def conversation_turns(turns: DataFrame) -> DataFrame:
    """conv_id and its ``turns``, an array of (label, words) in order of turn, NULL first; turns of one number by digest."""
    role, text = _text("role"), _text("text")
    told_apart = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    label = F.unhex(F.substring(F.sha2(told_apart, 256), 1, 32))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), label.alias("label"), F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words")
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "label", "words"))).alias("turns"))
    return listed.withColumn("turns", F.transform("turns", lambda t: F.struct(t.label.alias("label"), t.words.alias("words"))))


def branched(conversations: DataFrame) -> DataFrame:
    """Every conversation rebuilt as a branch: the first h turns of its family's first one, then its own after its first h.

    h is the CRC-32 of the decimal conv_id modulo 4.
    """
    heads = conversations.filter(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    joined = conversations.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "family", "left")
    head = F.when(F.col("head").isNull(), F.array().cast(joined.schema["head"].dataType)).otherwise(F.slice("head", F.lit(1), h))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def _named(sequences: DataFrame) -> DataFrame:
    """conv_id, ``path`` (name of each prefix and the words of its last turn) and ``end``, the name of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = batch.column("turns")
            flat = turns.flatten()
            labels, ends, names = flat.field("label").to_pylist(), [], []
            at = 0
            for size in turns.value_lengths().to_pylist():
                name = ROOT
                for label in labels[at : at + size]:
                    name = hashlib.blake2b(name + label, digest_size=16).digest()
                    names.append(name)
                at += size
                ends.append(name)
            starts = [0]
            for size in turns.value_lengths().to_pylist():
                starts.append(starts[-1] + size)
            steps = pa.StructArray.from_arrays([pa.array(names, pa.binary()), flat.field("words")], names=["name", "words"])
            path = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), steps)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(ends, pa.binary()), path], names=["conv_id", "end", "path"])

    return sequences.mapInArrow(run, "conv_id long, end binary, path array<struct<name: binary, words: long>>")


def _merged(pieces: DataFrame) -> DataFrame:
    """Equal pieces as one. The name at a piece's end stands for all that leads to it."""
    return pieces.groupBy("end").agg(
        *(F.first(c).alias(c) for c in ("root", "depth", "path")), F.min("conv").alias("conv"), F.sum("n").alias("n")
    )


def _halves(pieces: DataFrame, half: int) -> DataFrame:
    """Upper and lower halves of pieces: ``root`` is the name above a piece and ``depth`` its depth."""
    last = lambda path: F.element_at(path, -1)["name"]
    upper, lower = F.slice("path", 1, half), F.slice("path", half + 1, half)
    parts = F.array(
        F.struct(F.col("root"), F.col("depth"), upper.alias("path")),
        F.struct(F.element_at(upper, -1)["name"].alias("root"), (F.col("depth") + half).alias("depth"), lower.alias("path")),
    )
    cut = pieces.select(F.explode(F.filter(parts, lambda p: F.size(p.path) > 0)).alias("p"), "conv", "n")
    return _merged(cut.select("p.root", "p.depth", "p.path", "conv", "n").withColumn("end", last("path")))


def _graft(totals: DataFrame, pieces: DataFrame, half: int) -> DataFrame:
    """Totals of subtrees within pieces of twice the height, from those within pieces of height ``half``."""
    whole = 2 * half
    below = totals.filter(F.col("depth") % whole == (half + 1) % whole).groupBy("parent").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    paths = pieces.filter((F.col("depth") % whole == 0) & (F.size("path") == half)).select(F.col("end").alias("parent"), F.col("path.name").alias("names"))
    added = paths.join(below, "parent").select(F.explode("names").alias("name"), "leaves", "saved")
    both = totals.unionByName(added, allowMissingColumns=True)
    return both.groupBy("name").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _end_digests(named: DataFrame) -> DataFrame:
    """``end`` and the SHA-256 of the ascending, comma-joined ids of the conversations that end there.

    A digest is sequential; its task reads blocks of joined ids in order, as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, digest = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name == end:
                    digest.update(b",")
                else:
                    if end is not None:
                        done.append((end, digest.hexdigest()))
                    end, digest = name, hashlib.sha256()
                digest.update(ids.encode())
            yield rows(done)
        yield rows([(end, digest.hexdigest())] if end is not None else [])

    def rows(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
        ends, digests = zip(*done, strict=True) if done else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(ends, pa.binary()), pa.array(digests, pa.string())], names=["end", "ends_sha256"])

    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    blocks = named.groupBy("end", F.shiftright("conv_id", BLOCK).alias("block")).agg(ids.alias("ids"))
    return blocks.repartition("end").sortWithinPartitions("end", "block").mapInArrow(run, "end binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences (conv_id, ``turns`` of label and words), the empty one included.

    conv_id and parent_conv_id are the smallest members of the prefix and of its parent, n_convs its members, n_children and
    n_leaves count child nodes and childless nodes of its subtree, saved_tokens adds up (n_convs - 1) times the words of the
    last turn over the subtree, ends_sha256 digests the members that end there. ``sequences`` has one row per conv_id, never
    NULL; ``turns`` may be empty. No sequence at all gives no row.
    """
    named = stored(_named(sequences), "named")
    whole = stored(named.groupBy("end").agg(F.first("path").alias("path"), F.min("conv_id").alias("conv"), F.count("*").alias("n")), "sequences")
    longest = whole.agg(F.max(F.size("path"))).first()[0] or 0

    pieces, height, levels = whole.filter(F.size("path") > 0).withColumns({"root": F.lit(ROOT), "depth": F.lit(0)}), 1, {}
    while height < longest:
        height *= 2
    while height > 1:
        height //= 2
        pieces = levels[height] = stored(_halves(pieces, height), "pieces")
    nodes = pieces.select(
        F.col("end").alias("name"), F.col("root").alias("parent"), (F.col("depth") + 1).alias("depth"), F.element_at("path", 1)["words"].alias("words"), "conv", "n"
    )
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    none = F.lit(0).cast("long")
    nodes = stored(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", none)), "nodes")

    leaf = (F.col("n_children") == 0).cast("long")
    totals = nodes.select("name", "parent", "depth", leaf.alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    for half in sorted(levels):
        totals = stored(_graft(totals, levels[half], half), "totals")

    # The root adds up its children and saves nothing itself.
    first = totals.filter("depth = 1").agg(F.count("*").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    everyone = named.agg(F.min("conv_id").alias("conv"), F.count("*").alias("n")).filter("n > 0")
    root = everyone.join(F.broadcast(first)).select(
        F.lit(ROOT).alias("name"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), "conv", "n", "n_children",
        F.coalesce("leaves", F.lit(1).cast("long")).alias("leaves"), F.coalesce("saved", none).alias("saved"),
    )
    described = nodes.drop("words").join(totals.select("name", "leaves", "saved"), "name").unionByName(root)
    described = stored(described.join(_end_digests(named), F.col("name") == F.col("end"), "left").drop("end"), "described")
    parents = described.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv_id"))
    return spread_join(described, parents, ["parent"], "left").select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The prefix trie of all rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    NULL roles and texts count as empty; a NULL turn comes first; turns of one number are ordered by digest; equal rows are
    turns of their own. Rows with a NULL conv_id belong to no conversation. Other columns are ignored. Texts may have any
    length. An empty table gives an empty result.
    """
    return prefix_trie(branched(conversation_turns(turns)))

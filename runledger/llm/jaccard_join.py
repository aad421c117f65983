"""Exact Jaccard join over word shingles with a token-group matrix.

Documents with equal texts are compared once. Similar texts are put into groups; the matrix holds each group's token
union. For a query the tokens that it shares with a group's union bound its similarity to every member, and only
groups that can reach the threshold are opened.

Tokens are hashes of shingles. Groups and bounds work on the tokens with small hashes (a fixed share of all tokens, or as
many as the prefix filter needs), which keeps the matrix narrow; a bound that holds for some of the tokens holds for all.
The most frequent tokens, a bounded list counted over all documents, come last in every order, so passages that many
documents share do not bring these together.
Opening a group reads whole texts and compares whole sets, so the result is exact.

A query only meets groups with which it shares a token of its prefix, the tokens that are rarest over all texts. Texts
that are found similar to the head of their group are joined first. After that only groups of other components matter, so
thousands of near copies of one text are not compared with one another.

Texts of many components that share a prefix token are a crowd: near copies of one text that are just too far from
its head, say. They are held as differences to the core of the crowd, the tokens of most of its texts. Two texts are as
far from each other as their differences are, so texts close to the core link at once, and the others only link with
texts with which they share difference tokens, which are rare where the texts' own are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.batches import slices, texts_of
from runledger.llm.components import connected_components
from runledger.llm.storage import stored
from runledger.llm.textbytes import Texts, mix, span_hashes, word_spans

SHINGLE, PERCENT = 3, 90
# The share of all tokens that are always in the matrix, those with small hashes, as a multiple of the prefix's share.
LOW_SHARE = 1.5
# Texts in a group, and queries that meet a copy of an opened group, on average.
GROUP, QUERIES = 64, 256
# Frequent tokens: how many are listed at most, how many a task reports, and from how many texts on.
FREQUENT, REPORTED, OFTEN = 32_768, 16_384, 64
# Texts with one prefix token, those of its largest component aside, from which on they are held as differences.
CROWD = 32
_FACTORS = mix(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)
_SETS = "id long, check long, doc_id long, n long, cold long, tokens array<long>"


def low_limit(percent: int) -> int:
    """Tokens below this 63-bit hash are low."""
    return int(2**63 * min(1.0, LOW_SHARE * (100 - percent) / 100))


def shingle_sets(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text in a row, and where each text's begin and end (one more than texts).

    Words are runs without ASCII white space, with A-Z lowered. A text with fewer words than ``size`` has its whole
    sequence as its only shingle, one without words has none.
    """
    if not texts:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    t = Texts.of(texts)
    data = t.lowered()
    starts, ends = word_spans(data)
    doc = np.searchsorted(t.starts, starts, "right") - 1
    word = span_hashes(data, starts, ends)
    count = np.bincount(doc, minlength=len(texts))
    width = np.minimum(count, size)[doc]
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = place + width <= count[doc]
    hashes = width.astype(np.uint64)
    for i in range(size):
        shifted = np.zeros(len(word), np.uint64)
        shifted[: len(word) - i] = word[i:]
        hashes = hashes + np.where(width > i, shifted, np.uint64(0)) * _FACTORS[i]
    hashes, doc = (mix(hashes) >> np.uint64(1)).astype(np.int64)[first], doc[first]
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def prefix_length(n, percent: int = PERCENT):
    """Of ``n`` tokens, how many contain one of every set of similar size that reaches the threshold."""
    return n - (n * percent + 99) // 100 + 1


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _hash() -> Column:
    return F.xxhash64(_text())


def _check() -> Column:
    """A second hash of the text: texts are equal where both hashes are."""
    return F.xxhash64(F.lit(1), _text())


def _frequent(docs: DataFrame, size: int) -> np.ndarray:
    """The most frequent tokens in ascending order, at most FREQUENT.

    Every task counts the tokens of all its texts in a summary that keeps the most frequent ones; a token that is missed
    costs time and no result, as any order of tokens does that is one for all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part in (part for batch in batches for part in slices(batch)):
            tokens, _ = shingle_sets(texts_of(part), size)
            found, n = np.unique(tokens, return_counts=True)
            known = np.concatenate([kept, found[n > 1]])
            total = np.concatenate([counts, n[n > 1]])
            kept, at = np.unique(known, return_inverse=True)
            counts = np.bincount(at, total, len(kept)).astype(np.int64)
            if len(kept) > REPORTED:
                most = np.sort(np.argpartition(counts, -REPORTED)[-REPORTED:])
                kept, counts = kept[most], counts[most]
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(counts)], names=["token", "n"])

    counted = docs.select(_text().alias("text")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = counted.filter(F.col("n") >= OFTEN).orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toPandas()
    return np.sort(rows.token.to_numpy(np.int64))


def _sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """A row per different text (``hash`` and ``check``): ``id``, smallest doc_id, set size, tokens for the matrix.

    First ``cold`` tokens that are not frequent, in ascending order: all low ones, or more where the prefix needs them. After
    them come frequent tokens, where a text has too few others.
    """
    limit, frequent = low_limit(percent), _frequent(docs, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            tokens, bounds = shingle_sets(texts_of(part), size)
            n = np.diff(bounds)
            doc = np.repeat(np.arange(len(n)), n)
            hot = np.zeros(len(tokens), bool)
            if len(frequent):
                hot = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
            cold = np.bincount(doc[~hot], minlength=len(n))
            low = np.bincount(doc[~hot & (tokens < limit)], minlength=len(n))
            prefix = np.where(n > 0, prefix_length(n, percent), 0)
            held_cold, held_hot = np.minimum(np.maximum(low, prefix), cold), np.maximum(prefix - cold, 0)
            # Cold tokens of each text before its frequent ones.
            order = np.lexsort((tokens, hot, doc))
            tokens = tokens[order]
            place = np.arange(len(tokens)) - np.repeat(bounds[:-1], n)
            keep = (place < held_cold[doc]) | ((place >= cold[doc]) & (place < (cold + held_hot)[doc]))
            ends = np.append(0, np.cumsum(held_cold + held_hot)).astype(np.int32)
            columns = [part.column("id"), part.column("check"), part.column("doc_id"), pa.array(n), pa.array(held_cold), pa.ListArray.from_arrays(ends, pa.array(tokens[keep]))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "check", "doc_id", "n", "cold", "tokens"])

    rows = docs.select(_hash().alias("id"), _check().alias("check"), F.col("doc_id").cast("long"), _text().alias("text"))
    first = [F.min("doc_id").alias("first_doc"), *(F.first(c).alias(c) for c in ("n", "cold", "tokens"))]
    found = rows.mapInArrow(run, _SETS).groupBy(F.col("id").alias("hash"), "check").agg(*first)
    return _told_apart(stored(found.withColumn("id", F.col("hash")), "sets"))


def _told_apart(sets: DataFrame) -> DataFrame:
    """``sets`` with another ``id`` for texts that share their hash with a different one, which next to none do."""
    clashes = sets.groupBy("hash").agg(F.count("*").alias("texts"), F.min("check").alias("least")).filter("texts > 1")
    clashes = stored(clashes.select("hash", "least"), "clashes")
    if clashes.isEmpty():
        return sets
    own = F.when(F.col("check") != F.col("least"), F.xxhash64("hash", "check")).otherwise(F.col("hash"))
    return stored(sets.join(clashes, "hash", "left").withColumn("id", F.coalesce(own, "hash")).drop("least"), "sets")


def _low(percent: int) -> Column:
    """A text's low tokens that are not frequent."""
    return F.filter(F.slice("tokens", 1, F.col("cold").cast("int")), lambda t: t < low_limit(percent))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(token, id, n, early): of each text's prefix the tokens that another text has too.

    Order of tokens: low ones by their number of texts, the others by hash, frequent ones last. The first token that two
    similar sets share is in the prefix of the larger and, ``early``, in a shorter prefix of the smaller one.
    """
    tier = F.when(F.col("at") >= F.col("cold"), 2).when(F.col("token") >= low_limit(percent), 1).otherwise(0)
    rows = sets.select("id", "cold", F.posexplode("tokens").alias("at", "token")).select("id", "token", tier.cast("byte").alias("tier"))
    shared = rows.withColumn("texts", F.count("*").over(Window.partitionBy("token"))).filter("texts > 1")
    # A list holds tokens of one text.
    ranked = shared.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("tier", F.when(F.col("tier") == 0, F.col("texts")).alias("texts"), "token"))).alias("shared")
    )
    n = F.col("n")
    prefix = n - F.floor((n * percent + 99) / 100) + 1
    # Tokens of this text alone come first.
    taken = F.greatest(prefix - (F.size("tokens") - F.size("shared")), F.lit(0)).cast("int")
    low = F.size(_low(percent)) - F.size(F.filter("shared", lambda t: t.tier == 0))
    early = n - F.ceil(n * (2 * percent) / (100 + percent)) + 1 - low
    cut = ranked.join(sets, "id").select("id", "n", F.slice("shared", F.lit(1), taken).alias("shared"), early.alias("early"))
    listed = cut.select("id", "n", "early", F.posexplode("shared.token").alias("at", "token"))
    return listed.select("token", "id", "n", (F.col("at") < F.col("early")).alias("early"))


def _band(n: Column, percent: int) -> Column:
    """Sets that reach the threshold have sizes in the same band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / log(100 / percent)).cast("long")


def _whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (group, part, is_query, id, text) of some megabytes, parts of groups whole, without repeated ones."""
    held: list[tuple] = []
    total = 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("group", "part", "is_query", "id", "text")), strict=True):
            if total > 2_000_000 and held[-1][:2] != row[:2]:
                yield held
                held, total = [], 0
            if held and held[-1][:4] == row[:4]:
                continue
            held.append(row)
            total += len(row[4])
    yield held


def _open(size: int, percent: int):
    """Compares queries with the members of their group, from rows sorted by group, part and members first."""

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        tokens, bounds = shingle_sets([r[4] for r in rows], size)
        sets = [tokens[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        links = []
        start = 0
        while start < len(rows):
            end = start
            while end < len(rows) and rows[end][:2] == rows[start][:2]:
                end += 1
            own = range(start, end)
            members = {rows[i][3]: sets[i] for i in own if not rows[i][2]}
            union = np.unique(np.concatenate(list(members.values()))) if members else np.zeros(0, np.int64)
            for i in own:
                query = sets[i]
                if not rows[i][2] or 100 * len(np.intersect1d(query, union, assume_unique=True)) < percent * len(query):
                    continue
                for member, held in members.items():
                    both = len(np.intersect1d(query, held, assume_unique=True))
                    if member != rows[i][3] and 100 * both >= percent * (len(query) + len(held) - both):
                        links.append((rows[i][3], member))
                        break
            start = end
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_parts(batches):
            links = compare(rows)
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["id", "member"])

    return run


def _differ(size: int):
    """Differences of queries to the only member of their group: tokens that they add, and ~ of tokens that they miss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_parts(batches):
            tokens, bounds = shingle_sets([r[4] for r in rows], size)
            sets = [tokens[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            of, ids, n, found = [], [], [], []
            for row, own in zip(rows, sets, strict=True):
                if not row[2]:
                    head = own
                    continue
                of.append(row[0])
                ids.append(row[3])
                n.append(len(own))
                found.append(np.concatenate([np.setdiff1d(own, head, True), ~np.setdiff1d(head, own, True)]))
            if not found:
                continue
            ends = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32)
            columns = [*(pa.array(c, pa.int64()) for c in (of, ids, n)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))]
            yield pa.RecordBatch.from_arrays(columns, names=["head", "id", "n", "diff"])

    return run


def _met(members: DataFrame, queries: DataFrame, texts: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Texts of members and queries (group, id) by group, in parts of some queries that each hold all members.

    ``texts`` are the keys (id, key) of texts and rows (key, text); documents that repeat a key repeat rows.
    """
    keys, rows = texts
    n_queries = queries.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    copies = members.join(n_queries, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_query"), "id")
    parted = queries.join(n_queries, "group").select("group", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(True).alias("is_query"), "id")
    met = copies.unionByName(parted).join(keys, "id").join(rows, "key").select("group", "part", "is_query", "id", "text")
    return met.repartition("group", "part").sortWithinPartitions("group", "part", "is_query", "id")


def _links(members: DataFrame, queries: DataFrame, texts: tuple[DataFrame, DataFrame], size: int, percent: int) -> DataFrame:
    """For each query (group, id) a member (group, id) of its group that it links with, if there is one."""
    return _met(members, queries, texts).mapInArrow(_open(size, percent), "id long, member long")


def _differences(crowds: DataFrame, texts: tuple[DataFrame, DataFrame], size: int, percent: int) -> DataFrame:
    """A row per text of a crowd (head, id, component): its differences to the crowd's core and their ``excess``.

    Differences to the head are counted, and those of most texts are the core's own: a text that has one drops it, a text
    that lacks it differs there. With c = (100 - percent) / (100 + percent), two sets link when their symmetric
    difference is at most c times the sum of their sizes. Be a set's excess its differences less c times its size: two
    sets link when their excesses add up to at most twice the differences that they share. ``excess`` is in units of
    1 / (100 + percent).
    """
    heads = crowds.select(F.col("head").alias("group"), F.col("head").alias("id")).distinct()
    queries = crowds.select(F.col("head").alias("group"), "id")
    found = stored(_met(heads, queries, texts).mapInArrow(_differ(size), "head long, id long, n long, diff array<long>"), "differences")
    counted = found.select("head", F.explode("diff").alias("token")).groupBy("head", "token").agg(F.count("*").alias("texts"))
    most = counted.join(found.groupBy("head").agg(F.count("*").alias("members")), "head").filter("2 * texts > members")
    # Their number is at most twice the mean number of differences.
    core = most.groupBy("head").agg(F.collect_list("token").alias("core"))
    held = F.coalesce("core", F.array().cast("array<long>"))
    lacking = F.transform(F.array_except(held, "diff"), lambda t: F.bitwise_not(t))
    rows = found.join(core, "head", "left").select("head", "id", "n", F.concat(F.array_except("diff", held), lacking).alias("diff"))
    excess = F.size("diff") * (100 + percent) - F.col("n") * (100 - percent)
    return stored(rows.withColumn("excess", excess).join(crowds, ["head", "id"]), "relative")


def _crowd_links(crowds: DataFrame, texts: tuple[DataFrame, DataFrame], size: int, percent: int) -> DataFrame:
    """(id, member): links that join the texts of a crowd as far as any links within it do.

    The text of least excess links with all whose excess and its own add up to 0 at most, the inner ones. An outer text
    shares differences with every text that it links with. Of the differences, those of fewest texts first, one that both
    share is among the first of each, as in any prefix filter for an overlap that is known.
    """
    unit = 2 * (100 + percent)
    held = _differences(crowds, texts, size, percent)
    best = held.groupBy("head").agg(F.min(F.struct("excess", "id", "component")).alias("best"))
    state = held.join(best, "head").withColumn("outer", F.col("excess") + F.col("best.excess") > 0)
    sure = state.filter("not outer and component != best.component").select("id", F.col("best.id").alias("member"))

    # No text has to be looked for where none is outer.
    state = state.join(state.filter("outer").groupBy("head").agg(F.min("excess").alias("outer_least")), "head")
    d, n = F.size("diff").cast("long"), F.col("n")
    far_off = d - F.floor(n * (100 - percent) / percent)

    def last(partner: Column) -> Column:
        """The last place of a shared difference in the order, given the least excess of a partner."""
        return d - F.greatest(F.ceil((F.col("excess") + partner) / unit), far_off, F.lit(1).cast("long"))

    to_outer = last(F.col("outer_least"))
    state = state.select(
        "head", "id", "n", "excess", "outer", "diff", d.alias("d"), to_outer.alias("to_outer"),
        F.when(F.col("outer"), F.greatest(to_outer, last(F.col("best.excess")))).otherwise(to_outer).alias("to_any"),
        F.when(F.col("outer"), F.col("component")).otherwise(F.col("best.component")).alias("component"),
    )
    listed = state.select("head", "id", F.explode("diff").alias("token"))
    counted = listed.groupBy("head", "token").agg(F.count("*").alias("texts")).filter("texts > 1")
    # A list holds differences of one text.
    ranked = listed.join(counted, ["head", "token"]).groupBy("head", "id").agg(F.sort_array(F.collect_list(F.struct("texts", "token"))).alias("shared"))
    entries = ranked.join(state.drop("diff"), ["head", "id"]).withColumn("alone", F.col("d") - F.size("shared"))
    wanted = F.slice("shared.token", F.lit(1), F.greatest(F.col("to_any") - F.col("alone") + 1, F.lit(0)).cast("int"))
    entries = entries.select("head", "id", "n", "excess", "outer", "d", "to_outer", "component", "alone", F.posexplode(wanted).alias("at", "token"))
    entries = stored(entries.withColumn("at", F.col("at") + F.col("alone")).drop("alone"), "entries")
    a, b = entries.filter("outer").alias("a"), entries.alias("b")
    share = F.greatest(F.ceil((F.col("a.excess") + F.col("b.excess")) / unit), F.lit(1))
    possible = (
        (F.col("a.component") != F.col("b.component"))
        & (F.col("a.at") <= F.col("a.d") - share) & (F.col("b.at") <= F.col("b.d") - share)
        & (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent)
    )
    pair = ("head", F.col("a.id").alias("id"), F.col("b.id").alias("member"))
    near = a.filter("at <= to_outer").join(b.filter("outer and at <= to_outer"), ["head", "token"]).filter(possible & (F.col("a.id") < F.col("b.id"))).select(*pair)
    mixed = a.join(b.filter("not outer"), ["head", "token"]).filter(possible).select(*pair)
    pairs = stored(near.unionByName(mixed).groupBy("id", "member").agg(F.min("head").alias("head")), "pairs")

    of_id = held.select("head", "id", "diff", "excess")
    of_member = held.select("head", F.col("id").alias("member"), F.col("diff").alias("other_diff"), F.col("excess").alias("other_excess"))
    both = pairs.join(of_id, ["head", "id"]).join(of_member, ["head", "member"])
    shared = F.size(F.array_intersect("diff", "other_diff"))
    return sure.unionByName(both.filter(shared * unit >= F.col("excess") + F.col("other_excess")).select("id", "member"))


def _texts(docs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, key) of every text, the key of the document that stands for it, and (key, text) of every document."""
    key = F.struct(_hash().alias("hash"), _check().alias("check"), F.col("doc_id").cast("long").alias("doc"))
    keys = sets.select("id", F.struct("hash", "check", F.col("first_doc").alias("doc")).alias("key"))
    return keys, docs.select(key.alias("key"), _text().alias("text"))


def similar_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``.

    Two rows link when 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles; component_id is
    the smallest doc_id reachable by links, itself included. Rows with equal sets link, so repeated rows do; rows without
    words have an empty set and link with nothing. NULL text is an empty one. A NULL doc_id is never a component_id
    while its component has another one. Other columns are ignored; an empty table gives an empty result.
    """
    sets = _sets(docs, size, percent)
    prefixes = stored(_prefixes(sets.filter("n > 0"), percent), "prefixes")
    keys, rows = _texts(docs, sets)

    # Groups: each text goes to the one with which it shares most prefix tokens, of those that come first for a token.
    banded = prefixes.withColumn("band", _band(F.col("n"), percent))
    first = banded.groupBy("token", "band").agg(F.min("id").alias("group"))
    near = banded.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band")))).join(first, ["token", "band"]).filter("id != group")
    best = near.groupBy("id", "group").count().groupBy("id").agg(F.max_by("group", F.struct("count", "group")).alias("group"))
    best = stored(best, "groups")
    members = best.select("group", F.col("group").alias("id")).distinct()
    close = stored(_links(members, best, (keys, rows), size, percent), "links")

    # What is still open lies between components: a text of the smaller one asks the other's groups.
    known = connected_components(close)
    known = known.join(known.groupBy("component").agg(F.count("*").alias("weight")), "component")
    own = prefixes.join(known, F.col("id") == F.col("node"), "left").select(
        "token", "id", "n", "early", F.coalesce("component", "id").alias("component"), F.coalesce("weight", F.lit(1).cast("long")).alias("weight")
    )
    # Tokens of a single component can add nothing.
    same = Window.partitionBy("token")
    own = own.withColumn("several", F.min("component").over(same) < F.max("component").over(same)).filter("several").drop("several")
    chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("weight") / GROUP))
    own = stored(own.withColumn("group", F.xxhash64("component", chunk)).withColumn("band", _band(F.col("n"), percent)), "open")
    wanted = keys.join(own.select("id").distinct(), "id", "left_semi")
    texts = keys, stored(rows.join(wanted.select("key"), "key", "left_semi"), "texts")
    lists = own.groupBy("token", "component").agg(F.count("*").alias("texts"), F.min("id").alias("head"))
    lists = lists.groupBy("token").agg((F.sum("texts") - F.max("texts")).alias("others"), F.min("head").alias("head"))
    crowded = stored(lists.filter(F.col("others") > CROWD).select("token", "head"), "crowded")
    crowds = stored(own.join(crowded, "token").select("head", "id", "component").distinct(), "crowds")
    joined = stored(_crowd_links(crowds, texts, size, percent), "joined")

    few = own.join(crowded, "token", "left_anti")
    asked = few.groupBy("token", "band", "group", F.col("component").alias("other"), F.col("weight").alias("other_weight")).agg(
        F.max("early").alias("other_early")
    )
    asking = few.withColumn("step", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("band", F.col("band") + F.col("step"))
    # The token must be early in the smaller set; within a band either may be the smaller.
    first_shared = F.when(F.col("step") > 0, F.col("early")).when(F.col("step") < 0, F.col("other_early")).otherwise(F.col("early") | F.col("other_early"))
    smaller = F.struct("weight", "component") < F.struct(F.col("other_weight").alias("weight"), F.col("other").alias("component"))
    met = asking.drop("group").join(asked, ["token", "band"]).filter(smaller & first_shared).select("id", "n", "group").distinct()
    met = stored(met, "met")

    # The bound: of a query's low tokens that are not frequent no more may be missing from the group's union than the
    # threshold allows of all its tokens, against a member as small as any that it can reach.
    group_of = own.select("group", "id", "n").distinct()
    group_of = stored(group_of.join(met.select("group").distinct(), "group", "left_semi"), "members")
    low = _low(percent)
    # A group has about GROUP members. Their tokens are told apart before they meet.
    held = group_of.join(sets.select("id", low.alias("low")), "id").groupBy("group")
    unions = held.agg(F.array_distinct(F.flatten(F.collect_list("low"))).alias("union"), F.min("n").alias("smallest"))
    n = F.col("n")
    other = F.greatest("smallest", F.ceil(n * percent / 100))
    may_miss = n - F.ceil((n + other) * percent / (100 + percent))
    open_ = (
        met.join(sets.select("id", low.alias("low")), "id").join(unions, "group")
        .filter(F.size(F.array_except("low", "union")) <= may_miss).select("group", "id")
    )
    open_ = stored(open_, "queries")
    opened = group_of.join(open_.select("group").distinct(), "group", "left_semi").select("group", "id")
    far = _links(opened, open_, texts, size, percent)

    linked = connected_components(close.unionByName(joined).unionByName(far))
    of_text = sets.select("id", "hash", "check", "first_doc", F.col("n").alias("n_shingles")).join(linked, F.col("id") == F.col("node"), "left")
    of_text = of_text.withColumn("component", F.coalesce("component", "id"))
    smallest = of_text.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    named = of_text.join(smallest, "component").select("hash", "check", "n_shingles", "component_id")
    rows = docs.select(F.col("doc_id").cast("long"), _hash().alias("hash"), _check().alias("check")).join(named, ["hash", "check"])
    alone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", alone.alias("component_id"))


def drop_near_copies(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component, with all columns.

    Rows with a NULL doc_id stay; of rows that repeat a doc_id all stay or none.
    """
    found = similar_groups(docs, size, percent)
    dropped = found.filter("doc_id != component_id").select(F.col("doc_id").alias("dropped_doc")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["dropped_doc"], "left_anti")

"""Approximate nearest neighbours by learned partitions.

A bounded sample of distinct vectors is joined to a neighbour graph, and the graph is cut into parts of equal size with few
edges between them. A small classifier learns which parts a vector's neighbours are in. Every row is indexed in its most
probable part; a query is sent to its most probable parts, as many as the sample needs for the aimed recall, and all
rows there are ranked by exact cosine. Parts are cut into blocks and their queries into chunks, so no task grows with a
part, and a part may hold any share of the rows. The number of parts grows with the table up to what the sample can tell apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.storage import stored

NEAREST, EVERY = 5, 50
# Distinct vectors that the graph and the classifier are fitted on, at most; rows aimed at in a part; fewest sampled vectors of a part.
SAMPLE, PART, LEAST = 16_384, 1_000, 64
# Neighbours in the graph, passes that move its nodes, and how much a part may exceed its fair size.
DEGREE, PASSES, SLACK = 10, 8, 1.05
# Hidden units, epochs, rows of a step and step size of the classifier.
HIDDEN, EPOCHS, STEP, RATE = 96, 24, 256, 3e-3
# Recall that the number of visited parts is chosen for, on so many sampled vectors.
AIM, TRIED = 0.95, 1_024
BLOCK, CHUNK = 4_096, 1_024
_INDEXED = "uid long, vec_id long, vector binary, dimension int"


def neighbours(x: np.ndarray, degree: int) -> np.ndarray:
    """The ``degree`` nearest other rows of each unit row by cosine, nearest first."""
    degree = min(degree, len(x) - 1)
    found, narrow = np.zeros((len(x), degree), np.int64), x.astype(np.float32)
    for start in range(0, len(x), 1_024):
        near = narrow[start : start + 1_024] @ narrow.T
        rows = np.arange(len(near))
        near[rows, start + rows] = -np.inf
        some = np.argpartition(-near, degree - 1, axis=1)[:, :degree]
        order = np.argsort(-near[rows[:, None], some], axis=1, kind="stable")
        found[start : start + len(near)] = some[rows[:, None], order]
    return found


def balanced_parts(graph: np.ndarray, parts: int) -> np.ndarray:
    """A part for each node: grown by breadth-first search, then every node in turn moves to where most of its neighbours are.

    A move counts the neighbours in a part, less for a fuller part, and none goes to a part that is full.
    """
    n = len(graph)
    both = [set(row) for row in graph.tolist()]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            both[j].add(i)
    lists = [np.fromiter(sorted(s), np.int64, len(s)) for s in both]
    order, seen = [], np.zeros(n, bool)
    for start in range(n):
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        for i in queue:
            for j in graph[i]:
                if not seen[j]:
                    seen[j] = True
                    queue.append(int(j))
        order += queue
    part = np.zeros(n, np.int64)
    part[order] = np.arange(n) * parts // n
    room = np.ceil(SLACK * n / parts)
    size = np.bincount(part, minlength=parts).astype(np.float64)
    for _ in range(PASSES):
        moved = 0
        for i in order:
            old = part[i]
            size[old] -= 1
            gain = np.bincount(part[lists[i]], minlength=parts) * np.maximum(1 - size / room, 0)
            new = int(gain.argmax())
            if gain[new] <= gain[old]:
                new = old
            part[i] = new
            size[new] += 1
            moved += new != old
        if not moved:
            break
    return part


@dataclass(frozen=True)
class Router:
    """A classifier with one hidden layer, and how many of its most probable parts a query visits."""

    w: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray
    visits: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w + self.b, 0) @ self.v + self.c

    def home(self, x: np.ndarray) -> np.ndarray:
        return self.scores(x).argmax(1)

    def visited(self, x: np.ndarray, most: int | None = None) -> np.ndarray:
        """The most probable parts of each row, most probable first."""
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, : most or self.visits]


def train(x: np.ndarray, target: np.ndarray, seed: int = 0) -> Router:
    """Softmax regression on a hidden layer; ``target`` holds the shares of each row's neighbours in each part."""
    rng = np.random.default_rng(seed)
    dimension, parts = x.shape[1], target.shape[1]
    values = [
        rng.normal(0, np.sqrt(2 / dimension) * np.sqrt(dimension) / 2, (dimension, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts),
    ]
    values = [v.astype(np.float32) for v in values]
    x, target = x.astype(np.float32), target.astype(np.float32)
    mean, square = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for start in range(0, len(x), STEP):
            own = order[start : start + STEP]
            w, b, v, c = values
            hidden = np.maximum(x[own] @ w + b, 0)
            raw = hidden @ v + c
            raw = np.exp(raw - raw.max(1, keepdims=True))
            error = (raw / raw.sum(1, keepdims=True) - target[own]) / len(own)
            back = (error @ v.T) * (hidden > 0)
            slopes = [x[own].T @ back, back.sum(0), hidden.T @ error, error.sum(0)]
            step += 1
            for k, slope in enumerate(slopes):
                mean[k] = 0.9 * mean[k] + 0.1 * slope
                square[k] = 0.999 * square[k] + 0.001 * slope**2
                values[k] = values[k] - RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*(v.astype(np.float64) for v in values))


def fit_router(x: np.ndarray, parts: int) -> Router:
    """A router of unit vectors; visits are the fewest with which sampled vectors find the aimed share of their neighbours."""
    graph = neighbours(x, DEGREE)
    part = balanced_parts(graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x))[:, None], part[graph]), 0.5 / graph.shape[1])
    target[np.arange(len(x)), part] += 0.5
    router = train(x, target)
    home = router.home(x)
    tried = np.linspace(0, len(x) - 1, min(TRIED, len(x))).astype(np.int64)
    place = np.empty((len(tried), parts), np.int64)
    np.put_along_axis(place, router.visited(x[tried], parts), np.arange(parts)[None, :].repeat(len(tried), 0), 1)
    needed = place[np.arange(len(tried))[:, None], home[graph[tried][:, :NEAREST]]]
    found = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    return Router(router.w, router.b, router.v, router.c, int(np.searchsorted(found, AIM) + 1))


def _usable(vectors: DataFrame) -> DataFrame:
    """uid, vec_id, the vector divided by its length as bytes, and its dimension, of every row that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, raw, sizes = [], [], []
            for i, x in enumerate(batch.column("embedding").to_pylist()):
                v = np.array([np.nan if c is None else c for c in x or ()], np.float64)
                if not len(v) or not np.isfinite(v).all() or not v.any():
                    continue
                # Huge and tiny values are scaled before they are squared; adding zero makes -0.0 and 0.0 equal.
                v = v / np.abs(v).max()
                kept.append(i)
                raw.append((v / np.linalg.norm(v) + 0.0).tobytes())
                sizes.append(len(v))
            at = pa.array(kept, pa.int64())
            columns = [batch.column("uid").take(at), batch.column("vec_id").take(at), pa.array(raw, pa.binary()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "vec_id", "vector", "dimension"])

    named = vectors.filter("vec_id IS NOT NULL").select(
        F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")
    )
    return named.mapInArrow(run, _INDEXED)


def _router(rows: DataFrame) -> tuple[int, Router | None]:
    """The commonest dimension and a router for it; None where one part is enough."""
    counted = rows.groupBy("dimension").count().orderBy(F.desc("count"), "dimension").first()
    if counted is None:
        return 0, None
    own = rows.filter(F.col("dimension") == counted.dimension)
    # Equal vectors are sampled once; only digests are told apart over all rows.
    keys = own.select(F.xxhash64("vector").alias("key")).distinct().orderBy("key").limit(SAMPLE)
    sample = own.withColumn("key", F.xxhash64("vector")).join(F.broadcast(keys), "key").groupBy("key").agg(F.first("vector").alias("vector"))
    parts = min(counted["count"] // PART, SAMPLE // LEAST)
    if parts < 2:
        return counted.dimension, None
    held = sample.orderBy("key").select("vector").toPandas().vector
    parts = min(parts, len(held) // LEAST)
    x = np.frombuffer(b"".join(held), np.float64).reshape(len(held), -1)
    return counted.dimension, fit_router(x, parts) if parts > 1 else None


def _placed(rows: DataFrame, dimension: int, router: Router | None, queries: bool) -> DataFrame:
    """Adds the part in which a row is indexed, or those that a query visits. Rows of other dimensions have a part each."""
    if router is None:
        return rows.withColumn("parts", F.array(F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(i, BLOCK) for batch in batches for i in range(0, batch.num_rows, BLOCK)):
            own = np.flatnonzero(part.column("dimension").to_numpy() == dimension)
            parts = [[0]] * part.num_rows
            if len(own):
                x = np.frombuffer(b"".join(part.column("vector").take(pa.array(own)).to_pylist()), np.float64).reshape(len(own), -1)
                to = router.visited(x) if queries else router.home(x)[:, None]
                for i, p in zip(own, to.tolist(), strict=True):
                    parts[i] = p
            yield part.append_column("parts", pa.array(parts, pa.list_(pa.int32())))

    return rows.mapInArrow(run, f"{_INDEXED}, parts array<int>")


def _ranked(rows: pd.DataFrame, nearest: int) -> pd.DataFrame:
    """The nearest members of a block for each query of a chunk."""
    queries, members = rows[rows.is_query], rows[~rows.is_query].sort_values(["vec_id", "uid"])
    # Of equal vectors only the first few can be among a query's nearest, and one of them may be the query itself.
    members = members[members.groupby("vector", sort=False).cumcount() <= nearest]
    out = {"uid": [], "query_id": [], "vec_id": [], "score": [], "member": []}
    if len(queries) and len(members):
        q, m = (np.frombuffer(b"".join(side.vector), np.float64).reshape(len(side), -1) for side in (queries, members))
        ids, uids = members.vec_id.to_numpy(), members.uid.to_numpy()
        kept = min(nearest + 1, len(m))
        for start in range(0, len(q), 256):
            near = q[start : start + 256] @ m.T
            least = np.partition(near, len(m) - kept, axis=1)[:, len(m) - kept]
            for i, (row, low) in enumerate(zip(near, least, strict=True), start):
                some = np.flatnonzero(row >= low - 1e-12)
                some = some[uids[some] != queries.uid.iat[i]]
                # One way to add up for every pair, so equal vectors get equal scores in every block.
                score = (m[some] * q[i]).sum(axis=1)
                top = np.lexsort((uids[some], ids[some], -score))[:nearest]
                out["uid"] += [queries.uid.iat[i]] * len(top)
                out["query_id"] += [queries.vec_id.iat[i]] * len(top)
                out["vec_id"] += ids[some[top]].tolist()
                out["member"] += uids[some[top]].tolist()
                out["score"] += score[top].tolist()
    return pd.DataFrame(out).astype({"uid": "int64", "query_id": "int64", "vec_id": "int64", "score": "float64", "member": "int64"})


def nearest_vectors(vectors: DataFrame, is_query: Column | None = None, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score: the ``nearest`` rows found for each query among all other rows of ``vectors``.

    Queries are the rows for which ``is_query`` holds, by default those whose vec_id is divisible by 50. ``score`` is the cosine in
    double precision, ties go to the smaller vec_id; a query with fewer candidates gets all of them. Rows with a NULL vec_id and
    vectors that are NULL, empty, zero or hold NULL or non-finite values take no part; vectors of different dimensions have no
    cosine. Rows that repeat a vec_id are queries and candidates of their own. Other columns are ignored. An empty table gives
    an empty result. Every row is indexed; only the graph and the classifier are fitted on a sample (``SAMPLE``).
    """
    rows = stored(_usable(vectors), "vectors")
    dimension, router = _router(rows)
    wanted = F.col("vec_id") % EVERY == 0 if is_query is None else is_query
    key = ["dimension", "part"]
    spot = lambda parts: F.pmod(F.xxhash64("uid"), F.col(parts)).cast("int")
    members = stored(_placed(rows, dimension, router, False).withColumn("part", F.element_at("parts", 1)).drop("parts"), "members")
    asked = stored(_placed(rows.filter(wanted), dimension, router, True).withColumn("part", F.explode("parts")).drop("parts"), "queries")
    blocks = members.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    chunks = asked.groupBy(*key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    # Parts number at most SAMPLE / LEAST, and as many as there are dimensions.
    both = blocks.join(chunks, key)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = [*key, "block", "chunk", "is_query", "uid", "vec_id", "vector"]
    left = members.join(both, key).withColumn("block", spot("blocks")).withColumn("chunk", every("chunks")).withColumn("is_query", F.lit(False))
    right = asked.join(both, key).withColumn("chunk", spot("chunks")).withColumn("block", every("blocks")).withColumn("is_query", F.lit(True))
    tasks = left.select(*kept).unionByName(right.select(*kept)).groupBy(*key, "block", "chunk")
    found = tasks.applyInPandas(lambda part: _ranked(part, nearest), "uid long, query_id long, vec_id long, score double, member long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id", "member")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")

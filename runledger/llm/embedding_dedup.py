"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative per group.

Equal vectors of a label are one class and are compared once. Centres are fitted on a bounded sample; those nearer to each
other than two linking angles are one, so a tight group stays in a cell. Every class has a home cell, that of the nearest
centre, and visits every cell that can be home to a class that links with it and is not farther from its own centre. Of
two classes that link, the one farther from its centre therefore visits the other's home, and is counted there: by the
triangle inequality its angle to that centre is at most its own home angle and the linking angle, and it is no farther
than the linking angle from the border between the two cells. All pairs are found whatever the centres are. A cell is
cut into blocks of a bounded number of classes; each pair of blocks is one matrix product in double precision. Blocks
report how many vectors each vector links with, and ties that connect the linked ones, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.components import connected_components
from runledger.llm.storage import stored

COSINE = 0.98
# Vectors that centres are fitted on, classes per centre that are aimed at, and centres, at most.
SAMPLE, CELL, CENTRES, ROUNDS = 20_000, 2_000, 1_024, 12
BLOCK = 1_024
# Added to bounds against rounding, and rows that are placed at a time.
SLACK, PLACED = 1e-6, 1_024


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. Huge and tiny values are scaled before they are squared."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def fit_centres(vectors: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means; empty clusters keep their centre."""
    if not len(vectors):
        return np.zeros((0, 0))
    x = unit(vectors)
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def _classes(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the class of every vector that can link: its label, dimension and a digest of its values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, kept = [], []
            for x in batch.column("embedding").to_pylist():
                v = np.array([np.nan if c is None else c for c in x or ()], np.float64) + 0.0
                good = len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
                kept.append(v.tolist() if good else None)
                keys.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if good else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(kept, pa.list_(pa.float64()))],
                names=["vec_id", "label", "key", "vector"],
            )

    narrow = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return narrow.mapInArrow(run, "vec_id long, label string, key binary, vector array<double>")


def linking_angle(cosine: float) -> float:
    return float(np.arccos(np.clip(cosine, -1, 1)))


def merged(centres: np.ndarray, cosine: float) -> np.ndarray:
    """Centres of which no two are within two linking angles; an earlier centre stands for later ones."""
    near = centres @ centres.T >= np.cos(min(np.pi, 2 * linking_angle(cosine)))
    kept: list[int] = []
    for i in range(len(centres)):
        if not near[i, kept].any():
            kept.append(i)
    return centres[kept]


def visits(x: np.ndarray, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell and home angle of unit vectors, and which other cells each has to visit."""
    reach = linking_angle(cosine)
    near = np.clip(x @ centres.T, -1, 1)
    home, every = near.argmax(1), np.arange(len(x))
    angle = np.arccos(near[every, home])
    visited = np.arccos(near) <= angle[:, None] + reach + SLACK
    if reach < np.pi / 2:
        # The sine of the angle to the border between two cells is the difference of the cosines over the centres' distance.
        apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
        visited &= near[every, home][:, None] - near <= np.sin(reach) * apart[home] + SLACK
    visited[every, home] = False
    return home, angle, visited


def _cells(classes: DataFrame, centres: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """Adds the angle to the home centre, and the home cell (first) and the visited cells of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(i, PLACED) for batch in batches for i in range(0, batch.num_rows, PLACED)):
            vectors = part.column("vector").to_pylist()
            angles, cells = np.zeros(len(vectors)), [[0] for _ in vectors]
            sizes = np.array([len(v) for v in vectors])
            for dimension in set(sizes.tolist()) & set(centres):
                own = np.flatnonzero(sizes == dimension)
                home, angles[own], visited = visits(unit(np.array([vectors[i] for i in own])), centres[dimension], cosine)
                for i, h, row in zip(own, home, visited, strict=True):
                    cells[i] = [int(h), *np.flatnonzero(row).tolist()]
            yield part.append_column("angle", pa.array(angles)).append_column("cells", pa.array(cells, pa.list_(pa.int32())))

    return classes.mapInArrow(run, "id long, label string, size long, vector array<double>, angle double, cells array<int>")


def _compare(rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links between the two blocks of a task, or within its one block."""
    left, right = rows[rows.side == 0], rows[rows.side == 1]
    alone = len(right) == 0 and bool(rows.alone.iloc[0])
    right = left if alone else right
    empty = pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "tie": np.zeros(0, np.int64)})
    if not len(left) or not len(right):
        return empty
    a, b = (unit(np.stack(side.vector.to_list())) for side in (left, right))
    linked = a @ b.T >= cosine
    if alone:
        np.fill_diagonal(linked, False)
    elif right.visiting.any():
        # Two cells may both see a pair: the visit of the class farther from its home centre counts, then of the larger id.
        at_home, guest = left.angle.to_numpy()[:, None], right.angle.to_numpy()
        linked &= (guest > at_home) | ((guest == at_home) & (right.id.to_numpy() > left.id.to_numpy()[:, None]))
    ids_a, ids_b = left.id.to_numpy(), right.id.to_numpy()
    links = [pd.DataFrame({"id": ids_a, "links": linked @ right["size"].to_numpy()})]
    if not alone:
        links.append(pd.DataFrame({"id": ids_b, "links": linked.T @ left["size"].to_numpy()}))
    # Smallest id in reach within this task, by passing labels along the links until nothing changes.
    tie_a, tie_b = ids_a.copy(), ids_b.copy()
    at, of = np.nonzero(linked)
    while len(at):
        new_a, new_b = tie_a.copy(), tie_a.copy() if alone else tie_b.copy()
        np.minimum.at(new_a, at, (tie_a if alone else tie_b)[of])
        if alone:
            if (new_a == tie_a).all():
                break
            tie_a = new_a
        else:
            np.minimum.at(new_b, of, new_a[at])
            if (new_a == tie_a).all() and (new_b == tie_b).all():
                break
            tie_a, tie_b = new_a, new_b
    links[0]["tie"] = tie_a
    if not alone:
        links[1]["tie"] = tie_b
    found = pd.concat(links)
    return found[found.links > 0].astype({"links": np.int64})


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows link when their labels are equal and not NULL and their cosine is at least ``cosine``. A vector that is NULL, empty,
    zero or holds NULL or non-finite values links with nothing, as does one of another dimension. n_links counts the other rows
    linked with directly, component_id is the smallest vec_id reachable by links, and the row of that id is kept. Rows that
    repeat a vec_id are rows of their own and are kept or dropped alike; a NULL vec_id is never kept if linked, and has a
    NULL component_id if alone. Pairs are searched in cells that together see every pair that links.
    """
    rows = stored(_classes(vectors), "vectors")
    same = ["label", "key"]
    can_link = rows.filter("label IS NOT NULL AND key IS NOT NULL")
    grouped = can_link.groupBy(*same).agg(F.min("vec_id").alias("first_vec"), F.count("*").alias("size"), F.first("vector").alias("vector"))
    classes = stored(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")

    total = classes.groupBy(F.size("vector").alias("dimension")).count()
    wanted = {r.dimension: min(CENTRES, -(-r["count"] // CELL)) for r in total.orderBy(F.desc("count"), "dimension").limit(16).collect()}
    centres = {}
    for dimension, k in wanted.items():
        if k > 1:
            sample = classes.filter(F.size("vector") == dimension).orderBy(F.xxhash64("key"), "id").limit(SAMPLE).select("vector").toPandas()
            centres[dimension] = merged(fit_centres(np.stack(sample.vector.to_list()), k), cosine)
    placed = stored(_cells(classes.select("id", "label", "size", "vector"), centres, cosine), "cells")

    cell = ["label", "dimension", "cell"]
    spots = placed.withColumn("dimension", F.size("vector")).select("*", F.posexplode("cells").alias("visit", "cell"))
    counts = spots.groupBy(*cell).agg(
        F.ceil(F.count_if(F.col("visit") == 0) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count_if(F.col("visit") > 0) / BLOCK).cast("int").alias("guests")
    )
    blocked = spots.join(counts.filter("blocks > 0"), cell)
    visiting = F.col("visit") > 0
    own = F.when(visiting, F.col("blocks") + F.pmod(F.xxhash64("id", "cell"), F.col("guests"))).otherwise(F.pmod(F.xxhash64("id", "cell"), F.col("blocks")))
    # A home block meets itself, all other home blocks and all blocks of guests; a block of guests meets all home blocks.
    others = F.when(visiting, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.sequence(F.lit(0), F.col("blocks") + F.col("guests") - 1))
    tasks = (
        blocked.withColumn("block", own.cast("int"))
        .withColumn("other", F.explode(others))
        .select(
            *cell, F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
            (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("alone"),
            visiting.alias("visiting"), "angle", "id", "size", "vector",
        )
    )
    compared = tasks.groupBy(*cell, "one", "two").applyInPandas(lambda rows: _compare(rows, cosine), "id long, links long, tie long")
    found = stored(compared, "links")

    linked = connected_components(found.select("id", "tie"))
    n_links = found.groupBy("id").agg(F.sum("links").alias("links"))
    described = (
        classes.select("id", *same, "first_vec", "size")
        .join(n_links, "id", "left")
        .join(linked, F.col("id") == F.col("node"), "left")
        .withColumn("component", F.coalesce("component", "id"))
    )
    smallest = described.groupBy("component").agg(F.min("first_vec").alias("component_id"))
    named = described.join(smallest, "component").select(*same, (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    linkable = can_link.select("vec_id", *same).join(named, same).select("vec_id", "n_links", "component_id")
    alone = rows.filter("label IS NULL OR key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linkable.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def drop_near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The rows of ``vectors`` that are kept, with all columns; rows with a NULL vec_id are dropped."""
    kept = near_vectors(vectors, cosine).filter("kept").select(F.col("vec_id").alias("kept_vec")).distinct()
    return vectors.join(kept, vectors["vec_id"] == kept["kept_vec"], "left_semi")

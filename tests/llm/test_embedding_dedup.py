import numpy as np
import pytest

import brute
from runledger.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, size int, cells string, home int"


def plain(rows, cosine=E.COSINE):
    """{vec_id: (n_links, component_id, kept)}; rows that cannot link are None."""
    good = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v) > 0:
            good.setdefault((label, len(v)), []).append((i, np.array(v, np.float32).astype(float)))
    n, links = {i: 0 for i, _, _ in rows}, []
    for own in good.values():
        ids = [i for i, _ in own]
        x = np.stack([v / np.linalg.norm(v) for _, v in own])
        linked = x @ x.T >= cosine
        np.fill_diagonal(linked, False)
        for a, b in zip(*np.nonzero(linked)):
            n[ids[a]] += 1
            links.append((ids[a], ids[b]))
    of = brute.components(list(n), links)
    return {i: (n[i], of[i], of[i] == i) for i in n}


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(df).collect()}


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], 1), (5, [1.0, 0.0], None), (6, [1.0, 0.0], None), (7, None, 0),
        (8, [], 0), (9, [0.0, 0.0], 0), (10, [float("nan"), 1.0], 0), (11, [float("inf"), 1.0], 0), (12, [None, 1.0], 0), (13, [1.0, 0.0, 0.0], 0),
        (14, [-1.0, 0.0], 0), (15, [-0.0, 1.0], 0), (16, [0.0, 1.0], 0),
    ]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows)[3] == (2, 1, False) and run(spark, rows)[5] == (0, 5, True)


def test_huge_and_tiny_values(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [1e-200, 1e-200], 0), (4, [1.0, 1.0], 0), (5, [1e300, -1e300], 0), (6, [5e-324, 0.0], 0)]
    got = E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id) for r in got] == [(3, 1)] * 4 + [(0, 5), (0, 6)]


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_repeated_and_unnamed_rows(spark):
    got = E.near_vectors(spark.createDataFrame([(1, [1.0], 0), (1, [1.0], 0), (None, [1.0], 0)], "vec_id long, embedding array<float>, label int"))
    assert sorted(map(str, got.collect())) == sorted(map(str, [*got.filter("vec_id = 1").collect(), *got.filter("vec_id IS NULL").collect()]))
    assert [(r.n_links, r.component_id, r.kept) for r in got.orderBy("vec_id").collect()] == [(2, 1, False), (2, 1, True), (2, 1, True)]


@pytest.mark.parametrize("blocks", [(50, 30), (1_000, 16)])
def test_cells_and_blocks(spark, monkeypatch, blocks):
    """Small cells and blocks: groups over several cells, blocks and visits are still counted once."""
    monkeypatch.setattr(E, "CELL", blocks[0])
    monkeypatch.setattr(E, "BLOCK", blocks[1])
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = []
    for i in range(500):
        v = centres[rng.integers(0, 20 if i % 3 else 2)] + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.5])
        rows.append((i, [float(x) for x in np.float32(v)], int(rng.integers(0, 2))))
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(30)]
    got, want = run(spark, rows), plain(rows)
    found, all_ = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert all_ > 500 and found >= 0.9 * all_
    assert all(got[i][0] <= want[i][0] for i in want)
    if blocks[0] == 1_000:  # one cell, so nothing is missed
        assert got == want


def hot(n, seed):
    """A third of the vectors is one group with a mean cosine of about 0.985; others are near pairs and single ones."""
    rng = np.random.default_rng(seed)
    x = E.unit(rng.normal(size=(n, 24)))
    x[: n // 3] = E.unit(x[0] + rng.normal(size=(n // 3, 24)) * 0.0255)
    x[-n // 4 :] = E.unit(x[-n // 2 : -n // 4] + rng.normal(size=(n // 4, 24)) * rng.uniform(0.01, 0.06, size=(n // 4, 1)))
    return x


def test_all_links_of_a_hot_group_over_many_centres(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL", 20)
    monkeypatch.setattr(E, "BLOCK", 100)
    rows = [(i, [float(c) for c in np.float32(v)], 0) for i, v in enumerate(hot(1200, 5))]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("cosine", [0.98, 0.8, 0.3, -0.2])
def test_the_farther_of_two_linked_vectors_visits_the_home_of_the_other(cosine):
    x = hot(1500, 6)
    for centres in (E.fit_centres(x, 60), E.merged(E.fit_centres(x, 60), cosine)):
        home, angle, visited = E.visits(x, centres, cosine)
        a, b = np.nonzero(np.triu(x @ x.T >= cosine, 1))
        a, b = np.where(angle[a] >= angle[b], a, b), np.where(angle[a] >= angle[b], b, a)
        assert len(a) and ((home[a] == home[b]) | visited[a, home[b]]).all()


def test_filter(spark):
    rows = spark.createDataFrame([(1, [1.0], 0, "a"), (2, [1.0], 0, "b"), (3, [1.0], 1, "c")], "vec_id long, embedding array<float>, label int, kept string")
    assert sorted(r.kept for r in E.drop_near_vectors(rows).collect()) == ["a", "c"]


def test_query(spark):
    from runledger.llm.registry import queries

    sf_dir = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries()["op6_embedding_dedup"](spark, sf_dir).collect()}
    assert got == plain(rows)

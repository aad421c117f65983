import numpy as np
import pytest

from runledger.llm import nearest as N

SCHEMA = "vec_id long, embedding array<double>, label int, part int, uid int, block string, is_query int"


def plain(rows, k=5):
    """{query: [(vec_id, score)]} by comparing each query with every other row."""
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good.append((i, x / np.abs(x).max()))
    found = {}
    for at, (i, q) in enumerate(good):
        if i % 50 == 0:
            near = [(-(q @ m) / np.sqrt(q @ q) / np.sqrt(m @ m), j) for b, (j, m) in enumerate(good) if b != at and len(m) == len(q)]
            # Cosines that differ by rounding only are ties.
            found.setdefault(i, []).append([(j, -s) for s, j in sorted(near, key=lambda x: (round(x[0], 12), x[1]))[:k]])
    return found


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0, 1, 2, "x", 3) for r in rows], SCHEMA)
    found = {}
    for r in N.nearest_vectors(df).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return found


def same(got, wanted):
    assert got.keys() == {q for q, w in wanted.items() if w[0]}
    for q, near in got.items():
        assert [i for i, _ in near] == [i for i, _ in wanted[q][0]]
        assert np.allclose([s for _, s in near], [s for _, s in wanted[q][0]], rtol=0, atol=1e-12)


def recall(got, wanted):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w[0]}) / len(w[0]) for q, w in wanted.items()])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1e200, 1e200]), (3, [1e-200, 1e-200]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
        (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (50, [1.0, 1.0, 0.0]), (100, None), (150, [-1.0, -0.0]), (200, [0.0]), (250, [5.0]), (300, [1.0, 0.0]), (None, [1.0, 0.0]),
    ]
    same(run(spark, rows), plain(rows))


def test_empty_and_lonely(spark):
    assert run(spark, []) == {} and run(spark, [(50, [1.0, 2.0])]) == {} and run(spark, [(1, [1.0]), (2, [1.0])]) == {}


def test_repeated_ids(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, N.nearest_vectors(df).collect())) == [(50, 1, 50, 0.0), (50, 1, 50, 0.0)]


def hot(n, seed=2, dimension=32):
    """Clustered vectors; a third of the rows are one vector and a sixth near copies of another."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dimension))
    x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, dimension)) * 0.5
    x[: n // 3] = centres[0]
    x[n // 3 : n // 2] = centres[1] + rng.normal(size=(n // 2 - n // 3, dimension)) * 0.01
    order = rng.permutation(n)
    return [(int(i), x[j].tolist()) for i, j in enumerate(order)]


def test_blocks_and_ties(spark, monkeypatch):
    """Without a router the search is exact, in small blocks and chunks, with a third of the rows equal."""
    monkeypatch.setattr(N, "BLOCK", 100)
    monkeypatch.setattr(N, "CHUNK", 3)
    rows = hot(900)
    same(run(spark, rows), plain(rows))


def test_recall_with_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 150)
    rows = hot(4_000)
    got, wanted = run(spark, rows), plain(rows)
    assert recall(got, wanted) >= 0.9
    for near in got.values():
        assert len(near) == 5 and near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_parts_are_balanced_and_cut_little():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(8, 16)), 100, 0) + rng.normal(size=(800, 16)) * 0.2
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    graph = N.neighbours(x, 10)
    part = N.balanced_parts(graph, 8)
    assert np.bincount(part, minlength=8).max() <= np.ceil(N.SLACK * 100)
    assert (part[graph] == part[:, None]).mean() > 0.9


@pytest.mark.parametrize("name", ["sf0.1", "check_s"])
def test_recall_on_the_test_data(spark, monkeypatch, name):
    monkeypatch.setattr(N, "PART", 200 if name == "sf0.1" else N.PART)
    rows = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet").toPandas()
    x = np.stack(rows.embedding.to_list()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = rows.vec_id.to_numpy()
    got = {}
    table = spark.createDataFrame(list(zip(ids.tolist(), rows.embedding.map(list))), "vec_id long, embedding array<double>") if name == "sf0.1" else spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    for r in N.nearest_vectors(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for i in np.flatnonzero(ids % 50 == 0):
        near = x @ x[i]
        near[i] = -2
        best = np.lexsort((ids, -np.round(near, 12)))[:5]
        hits.append(len(got[ids[i]] & set(ids[best].tolist())) / 5)
    assert np.mean(hits) >= 0.9

import random

import pytest

import brute
from runledger.llm import jaccard_join as J
from conftest import ODD


def check(spark, rows, size=3, percent=90):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_groups(df, size, percent).collect()}
    sets = brute.similar(rows, percent) if size == 3 else None
    assert got == sets
    return got


def test_odd_rows(odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.similar_groups(odd).collect()), key=str)
    want = brute.similar([r for r in ODD if r[0] is not None])
    assert got == sorted([*((d, *want[d]) for d, _ in ODD if d is not None), (None, 4, 1)], key=str)


def test_filter(odd, nothing):
    kept = J.drop_near_copies(odd)
    assert kept.columns == odd.columns
    # Rows without words are alone; NULL ids stay.
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 5, 7, 8, 9, None]
    assert J.drop_near_copies(nothing).count() == 0
    assert J.similar_groups(nothing).columns == ["doc_id", "n_shingles", "component_id"]


@pytest.mark.parametrize("percent", [90, 80])
def test_random_edits_and_shared_passages(spark, percent):
    rnd = random.Random(percent)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choices(words, k=60))
    base = [" ".join(rnd.choices(words, k=rnd.randint(1, 160))) for _ in range(25)]
    rows = []
    for i in range(300):
        text = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 1 + len(text) // 40)):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((i, " ".join(text) + (" " + passage if rnd.random() < 0.3 else "")))
    got = check(spark, rows, percent=percent)
    assert len({c for _, c in got.values()}) < len(rows)


def test_many_near_copies_of_one_text(spark):
    rnd = random.Random(5)
    base = [f"v{i}" for i in range(100)]
    rows = []
    for i in range(400):
        text = list(base)
        text[rnd.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(base[: 90 - 10 * i])) for i in range(5)]
    check(spark, rows)


@pytest.mark.parametrize("edits, copied", [(1, False), (2, True)])
def test_crowds_about_the_threshold(spark, edits, copied):
    # Few words to edit with, so that texts share edits; sizes differ; with the common text itself and without it.
    rnd = random.Random(edits)
    base = [f"v{i}" for i in range(60 * edits)]
    rows = [(999, " ".join(base))] if copied else []
    for i in range(300):
        text = list(base)
        for _ in range(rnd.randint(edits, edits + 1)):
            text[rnd.randrange(len(text) // 3)] = rnd.choice("xyz")
        rows.append((i, " ".join(text[: len(text) - rnd.randint(0, 3)])))
    check(spark, rows)
    check(spark, rows, percent=80)


def test_near_misses_do_not_meet_in_pairs(spark, monkeypatch):
    made = {}

    def stored(df, label):
        kept = keep(df, label)
        if label in ("met", "pairs"):
            made[label] = made.get(label, 0) + kept.count()
        return kept

    keep = J.stored
    monkeypatch.setattr(J, "stored", stored)
    base = [f"v{i}" for i in range(120)]
    for copies in (500, 1_000):
        made.clear()
        rnd = random.Random(copies)
        rows = []
        for i in range(copies):
            text = list(base)
            for at in rnd.sample(range(120), 2):
                text[at] = f"x{i}-{at}"
            rows.append((i, " ".join(text)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in J.similar_groups(df).collect()}
        assert len(set(got.values())) > copies // 2
        assert sum(made.values()) <= 16 * copies, made


def test_texts_that_share_a_hash(spark, monkeypatch):
    from pyspark.sql import functions as F

    hashed = J._hash
    monkeypatch.setattr(J, "_hash", lambda: F.pmod(hashed(), F.lit(7)))
    base = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: 59 - i % 3], f"x{i}"])) for i in range(40)] + [(100 + i, f"other text {i % 9}") for i in range(30)]
    # Copies that repeat a doc_id too.
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_groups(df).collect()}
    assert got == brute.similar(rows)


def test_shingle_sets():
    tokens, bounds = J.shingle_sets(["A b", "a B", "a", "", "a b c d a b c", "é É"])
    sets = [set(tokens[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    assert [len(s) for s in sets] == [1, 1, 1, 0, 4, 1]
    assert sets[0] == sets[1] != sets[2]


def test_query_matches_brute_force(spark):
    from runledger.llm.registry import queries

    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op10_jaccard_join"](spark, sf_dir).collect()}
    assert got == brute.similar(rows)

import random

import pytest

import brute
from runledger.llm.line_dedup import drop_repeated_lines, repeated_lines
from conftest import ODD


@pytest.mark.parametrize("seed", range(3))
def test_random_lines(spark, seed):
    rnd = random.Random(seed)
    lines = ["", "a", "b", "c d", "e f g", "h i j k l m n o p"]
    pool = [rnd.choices(lines, k=rnd.randint(1, 20)) for _ in range(6)]
    rows = []
    for i in range(60):
        own = rnd.choice(pool)[rnd.randint(0, 3) :] if rnd.random() < 0.5 else rnd.choices(lines, k=rnd.randint(0, 12))
        rows.append((i, "\n".join(own)))
    got = repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 4).orderBy("doc_id").collect()
    assert [(r.doc_id, list(r.deleted)) for r in got] == brute.repeated_lines(rows, 4)
    assert [r.n_lines for r in got] == [t.count("\n") + 1 for _, t in rows]


def test_long_repeats(spark):
    """Runs whose length is no power of two, one copied many times, one overlapping itself."""
    run = [f"line {i} of the run" for i in range(37)]
    rows = [(i, "\n".join([f"own {i}", *run[i % 5 :], f"end {i}"])) for i in range(40)] + [(100, "\n".join(["a a a a a a a a"] * 21))]
    got = repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, list(r.deleted)) for r in got] == brute.repeated_lines(rows)


def test_odd_rows(odd, nothing):
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    got = repeated_lines(odd, 3).collect()
    assert sorted(((r.doc_id, list(r.deleted)) for r in got), key=str) == sorted(brute.repeated_lines(rows, 3), key=str)
    cut = drop_repeated_lines(odd, 3)
    assert cut.columns == odd.columns and cut.count() == len(ODD)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] == "" and texts[3] is None and texts[8] == "a\nb\nc" and texts[5] == " \n\t "
    assert repeated_lines(nothing).count() == 0 == drop_repeated_lines(nothing).count()


def test_query_matches_brute_force(spark):
    from runledger.llm.registry import queries

    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    got = queries()["op8_line_dedup"](spark, sf_dir).orderBy("doc_id").collect()
    assert [(r.doc_id, r.deleted) for r in got] == [(d, ",".join(map(str, gone))) for d, gone in brute.repeated_lines(rows)]

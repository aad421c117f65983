import hashlib
import re

from runledger.llm.exact_dedup import drop_exact_copies, exact_copies
from runledger.llm.registry import EXACT_SQL, queries
from compare import connect, differences
from conftest import ODD


def plain(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, i))
    out = []
    for key, own in groups.items():
        winner = rows[min(own)[3]][0]
        for o in own:
            out.append((rows[o[3]][0], winner, len(own), hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(odd):
    got = exact_copies(odd).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(ODD)
    # One row of each group is kept, also where rows repeat one another.
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_filter_keeps_all_columns(odd):
    kept = drop_exact_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 7, 8, 9]


def test_repeated_row_that_wins_is_kept_once(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "ab")], "doc_id long, text string")
    assert [tuple(r) for r in drop_exact_copies(rows).collect()] == [(1, "a b")]


def test_frequent_copies(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    got = exact_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == plain(rows)


def test_empty_table(nothing):
    assert exact_copies(nothing).count() == 0
    assert drop_exact_copies(nothing).columns == nothing.columns


def test_query_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert differences(queries()["op7_exact_dedup"](spark, sf_dir), connect(sf_dir), EXACT_SQL) == []


def test_native_plan(spark):
    plan = queries()["op7_exact_dedup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

import random
import zlib

import numpy as np
import pytest

from runledger.llm import quality, toxicity
from conftest import ODD

BAD = ["blorbo", "snarkle", "wizzen", "trogg"]


def corpus(n, seed):
    """(text, label): some texts hold a few bad words."""
    rnd = random.Random(seed)
    syllables = ["ta", "ri", "mon", "el", "su", "ka", "lin", "dor", "pe", "gha"]
    rows = []
    for i in range(n):
        words = ["".join(rnd.choices(syllables, k=rnd.randint(1, 4))) for _ in range(rnd.randint(30, 120))]
        label = int(i % 5 == 0)
        for _ in range(3 * label):
            words[rnd.randrange(len(words))] = rnd.choice(BAD)
        rows.append((" ".join(words), label))
    return rows


def accuracy(scores, labels, at):
    return np.mean((np.asarray(scores) >= at) == np.asarray(labels))


def test_toxicity_learns_on_other_texts():
    learned = corpus(800, 1)
    model = toxicity.fit([t for t, _ in learned], np.array([y for _, y in learned]))
    texts, labels = zip(*corpus(400, 2))
    assert accuracy(model.score(list(texts)), labels, 0.7) > 0.95
    assert 0 <= model.score([""])[0] < 0.5


@pytest.mark.parametrize("labels", [[], [1, 1], [0, 0, 0, 0, 0]])
def test_few_labels(labels):
    model = toxicity.fit(["some text"] * len(labels), np.array(labels, int))
    trees = quality.fit(np.zeros((len(labels), len(quality.STATISTICS))), np.array(labels, float))
    share = (sum(labels) + 0.5) / (len(labels) + 1)
    assert model.score(["x", ""]).tolist() == pytest.approx([share] * 2)
    assert trees.score(np.zeros((2, len(quality.STATISTICS)))).tolist() == pytest.approx([share] * 2)


def test_trees_fit_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit(x[:2000], y[:2000])
    assert accuracy(trees.score(x[2000:]), y[2000:], 0.5) > 0.97


def test_statistics_against_plain_counts():
    texts = ["The the  cat.\nThe the\n", "", "É| a!", "x" * 70_000, " \n "]
    x = quality.statistics(texts)
    got = [dict(zip(quality.STATISTICS, row, strict=True)) for row in x]
    assert np.isfinite(x).all() and quality.statistics([]).shape == (0, len(quality.STATISTICS))
    one = got[0]
    size = len(texts[0])
    assert one["upper"] == pytest.approx(2 / size) and one["line_breaks"] == pytest.approx(2 / size)
    assert one["distinct_words"] == pytest.approx(3 / 5) and one["most_frequent_word"] == pytest.approx(2 / 5)
    assert one["line_words"] == pytest.approx(5 / 2) and one["stops"] == pytest.approx(1 / 5)
    assert got[2]["non_ascii"] == pytest.approx(2 / 6) and got[2]["marked_words"] == pytest.approx(2 / 2)


@pytest.mark.parametrize("score, label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_rows(spark, odd, nothing, score, label):
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, None, None), (99, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = score(odd, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in ODD)
    for r in rows:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert score(nothing, labels).count() == 0
    assert score(odd, labels.limit(0)).first().score == 0.5


def test_filter_keeps_columns(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = quality.drop_poor(odd, labels)
    assert kept.columns == odd.columns and kept.count() == len(ODD)


@pytest.mark.parametrize("name, label, at, least", [("op4_quality_classifier", "quality", 0.5, 0.97), ("op2_toxicity", "toxic", 0.7, 0.9)])
def test_held_out_accuracy(spark, name, label, at, least):
    from runledger.llm.registry import queries

    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in queries()[name](spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert all(r.predicted == int(r.score >= at) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > least

"""Every stage of the pipeline against a plain version, on a thousand documents."""

import re

import numpy as np
import pytest

import brute
import corpus_pipeline as P
from runledger.llm import quality, secret_scan
from runledger.llm.tokens import load

SF_DIR = "/root/testdata/sf0.01"


def similar(rows, size, percent):
    sets = {d: brute.shingles(t, size) for d, t in rows}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    return brute.components(ids, links)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF_DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return [[r.asDict() for r in df.collect()] for df in out], [df.columns for df in out]


def test_columns(stages):
    assert all(columns == stages[1][0] for columns in stages[1][:-1])
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "exact_dedup", "jaccard_join", "secret_scan", "best_fit_packing"]


def test_quality(spark, stages):
    before, after = stages[0][0], stages[0][1]
    scores = quality.quality_scores(spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    good = {r.doc_id for r in scores.collect() if r.score >= 0.5}
    assert {r["doc_id"] for r in after} == good and 0 < len(after) < len(before)


def test_exact_copies(stages):
    best = {}
    for r in stages[0][1]:
        key = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
        best[key] = min(best.get(key, (1, 0)), (-len(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in stages[0][2]) == sorted(d for _, d in best.values())


def test_near_copies(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[0][2]]
    of = similar(rows, P.SHINGLE, P.PERCENT)
    assert sorted(r["doc_id"] for r in stages[0][3]) == sorted(set(of.values()))


def test_secrets_are_masked(stages):
    before, after = ({r["doc_id"]: r for r in rows} for rows in stages[0][3:5])
    assert set(before) == set(after)
    masked = 0
    for d, r in after.items():
        spans = secret_scan.base_spans(before[d]["text"])
        assert not secret_scan.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        masked += bool(spans)
        if not spans and "<secret>" not in r["text"]:
            assert r == before[d]
    assert masked


def test_packing(stages):
    tokenizer = load(P.public_tokenizers.path(P.WORD_BPE))
    texts = {r["doc_id"]: r["text"] for r in stages[0][4]}
    pieces, sequences = {}, {}
    for r in stages[0][5]:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, text in texts.items():
        ids = b"".join(i for _, i in sorted(pieces[d]))
        assert np.frombuffer(ids, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_run(spark, stages):
    assert P.run(spark, SF_DIR).count() == len(stages[0][5])

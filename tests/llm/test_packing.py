import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from runledger.llm import packing
from runledger.llm.tokens import load
from conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return [*load(PATH).encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_every_piece_once_without_gaps(seed):
    rnd = random.Random(seed)
    counts = Counter(min(64, max(1, int(rnd.lognormvariate(3, 1)))) for _ in range(rnd.randint(1, 3000)))
    placed, seen = defaultdict(list), Counter()
    for length, first, last, each, sequence, offset in packing.best_fit(counts, 64):
        for rank in range(first, last):
            k = rank - first
            placed[sequence + k // each].append((offset + k % each * length, length))
            seen[length] += 1
    assert seen == counts
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(placed) == list(range(len(placed)))
    total = sum(length * n for length, n in counts.items())
    assert len(placed) <= 11 / 9 * -(-total // 64) + 1


def test_pieces_and_places(odd):
    rows = packing.pack(odd, PATH, capacity=256).collect()
    of = defaultdict(list)
    for r in rows:
        of[r.doc_id].append(r)
    for doc_id, text in ODD:
        want = ids_of(text)
        times = sum(d == doc_id for d, _ in ODD)
        own = sorted(of[doc_id], key=lambda r: r.piece)
        assert sum(r.length for r in own) == times * len(want)
        first = {r.piece: r for r in own}
        assert np.concatenate([np.frombuffer(first[p].ids, "<u4") for p in sorted(first)]).tolist() == want
        assert [first[p].start for p in sorted(first)] == list(range(0, len(want), 256))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256


def test_empty_table(nothing):
    assert packing.pack(nothing, PATH).count() == 0


def test_query(spark):
    from runledger.llm.registry import queries

    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries()["op3_best_fit_packing"](spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        ids = np.array(ids_of(docs[r.doc_id])[r.start : r.start + r.length], "<u4")
        assert len(ids) == r.length and zlib.crc32(ids.tobytes()) == r.ids_crc32
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.02 * -(-total // 2048) + 1

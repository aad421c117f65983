import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runledger.llm import bpe, tokens
from conftest import ODD

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = {path: tokens.load(path) for path in (BYTE, WORD)}
PARTS = [
    "a", "b", " ", "  ", "\n", "\t", "'s", "'re", "é", "ß", "漢字", "🙂", "1", "23", "!", "'", "!'", "\x1c", "\x85", "\xa0", "<|endoftext|>", "the", "ing",
    "A", "Σ", "ΑΣ", "é", "İ", "\x00", ".", "###", "-", "\r\n", " a", "x" * 30,
]


def reference(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_merging_by_rank_is_allowed():
    """Ranks follow the merges and every token encodes to itself, so both ways of merging agree."""
    assert tokens.merges_by_rank(BYTE) and tokens.merges_by_rank(WORD)


@pytest.mark.parametrize("path, units", [(BYTE, tokens.spaced_words), (WORD, tokens.words)])
def test_units_give_the_library_s_ids(path, units):
    encoder = tokens.UnitEncoder(path, units, True)
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(PARTS, k=rnd.randint(0, 40))) for _ in range(1500)]
    texts += [" ".join(rnd.choices(["Là", "the", "WORLD.", "don't", "x1y", "ção,", "\n"], k=30)) for _ in range(200)]
    assert [ids(x) for x in encoder.encode(texts)] == [reference(path, t) for t in texts]


ENCODER = tokens.UnitEncoder(BYTE, tokens.spaced_words, True)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab '\né1!<|>", max_size=60))
def test_any_text(text):
    assert ids(ENCODER.encode([text])[0]) == reference(BYTE, text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=150) | st.lists(st.sampled_from(["a", "b", "c", "ab", "'", "s"]), max_size=300), st.integers(7, 60))
def test_tree_concatenation(parts, leaf):
    text = "".join(parts)
    joiner = bpe.Joiner(ENCODER, bpe.Decoder(BYTE))
    raw, bounds = text.encode(), bpe.leaf_bounds(text, leaf)
    places = [len(text[:b].encode()) for b in bounds]
    leaves = [(a, b, joiner._encode(raw[a:b])) for a, b in zip(places, places[1:])]
    assert bpe.tree_join(joiner, raw, leaves).tolist() == reference(BYTE, text)


def test_decoding():
    decoder = bpe.Decoder(BYTE)
    rnd = random.Random(2)
    for _ in range(300):
        some = [rnd.randrange(50257) for _ in range(rnd.randint(0, 12))]
        assert decoder.text(np.array(some, "<u4").tobytes()) == LIBRARY[BYTE].decode(some, skip_special_tokens=False)


def test_rows(odd, nothing):
    got = bpe.decode(bpe.encode(odd, BYTE, leaf=512), BYTE).collect()
    want = [(d, reference(BYTE, t or ""), t or "") for d, t in ODD]
    assert sorted(((r.doc_id, ids(r.ids), r.text) for r in got), key=str) == sorted(want, key=str)
    assert bpe.encode(nothing, BYTE).count() == 0


def test_query(spark):
    from runledger.llm.registry import queries

    sf_dir = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries()["op9_bpe"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        want = np.array(reference(BYTE, r.text), "<u4")
        row = got.pop(r.doc_id)
        assert (row.n_tokens, row.ids_sha256) == (len(want), hashlib.sha256(want.tobytes()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert not got

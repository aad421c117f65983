import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest

from runledger.llm import token_alignment as A

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row long, pair int, n int, times int, rare string, a int"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "a  b\n c\t\x00 d e<s>", " ", "  ", " x", "x ", " x  ", "<|endoftext|> and <|endoftext|>", "naïve café 北京 市 🙂🙂  x", "▁ lower one", "a▁b",
    "<0x41> <unk> </s>", "word " * 3_000, "x" * 5_000, "=" * 997, "\r\n\r\n  indented\n\tmore", "don't we'll I'D", "é ​  end", "١٢٣ 456 7890123",
]


def plain(rows):
    """By two libraries on whole texts and loops over all tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    first.encode_special_tokens = True
    bytes_a, bytes_b = A.byte_tokens(PATHS[0]), A.piece_tokens(PATHS[1])
    done, counts = [], Counter()
    for doc, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        whole = b" " + (text or "").encode()
        if not text or b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            done.append((doc, 0, 0, [], Counter()))
            continue
        ends = [set(), set()]
        for side, (ids, table) in enumerate(((a, bytes_a), (b, bytes_b))):
            at = 0
            for i in ids:
                at += len(table[i])
                ends[side].add(at)
        shared, groups = ends[0] & ends[1], []
        for side, (ids, table) in enumerate(((a, bytes_a), (b, bytes_b))):
            at, k = 0, 0
            for i in ids:
                if k == len(groups):
                    groups.append(([], []))
                groups[k][side].append(i)
                at += len(table[i])
                k += at in shared
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        counts.update(links.keys())
        done.append((doc, len(a), len(b), groups, links))
    highest = {}
    for (x, _), n in counts.items():
        highest[x] = max(highest.get(x, 0), n)
    out = []
    for doc, n_a, n_b, groups, links in done:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        best = sum(t for k, t in links.items() if counts[k] == highest[k[0]])
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups), sum(links.values()), best, sum(t * counts[k] for k, t in links.items()), digest))
    return out


def run(spark, rows, partitions=3):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, "x", 5) for r in rows], SCHEMA).repartition(partitions)
    return [tuple(r) for r in A.token_alignment(df, *PATHS).select(*COLUMNS).collect()]


def ordered(rows):
    return sorted(rows, key=str)


def test_odd_texts(spark):
    rows = [*enumerate(ODD), (90, None), (91, ""), (None, "no id"), (5, "twice"), (5, "twice")]
    assert ordered(run(spark, rows)) == ordered(plain(rows))


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("limits", [(200_000, 1_000_000, 1_000_000, 1_000_000, 0), (20, 7, 30, 5, 2), (0, 1, 1, 1, 64)])
def test_bounds_change_nothing(spark, monkeypatch, limits):
    """Few common pairs, small blocks of links, early reports and split rows; a third of the texts are equal."""
    for name, value in zip(("COMMON", "LINKS", "HELD", "ROW_PAIRS", "LARGE"), limits, strict=True):
        monkeypatch.setattr(A, name, value)
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma,", "don't", "ünïcode", "12345", "北京", "re-run", "\n", "", "abcabcabcabc", "🙂"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(40)] + [(100 + i, "the same words again") for i in range(20)]
    assert ordered(run(spark, rows)) == ordered(plain(rows))


def test_units_are_the_whole_text():
    """Cutting before spaces gives the ids of the whole text."""
    from sentencepiece import SentencePieceProcessor

    whole, rng = SentencePieceProcessor(model_file=PATHS[1]), random.Random(1)
    texts = ["".join(rng.choices("ab e.\n\t<0>é北🙂", k=rng.randint(1, 60))) for _ in range(2_000)] + ODD
    got = A.PieceEncoder(PATHS[1]).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        if "▁" not in text:
            assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == whole.encode(text), text


def test_documents_of_the_test_data(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ordered(tuple(r) for r in A.token_alignment(docs, *PATHS).select(*COLUMNS).collect()) == ordered(plain(rows))

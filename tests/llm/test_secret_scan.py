import hashlib
import random
import re

import numpy as np

from runledger.llm import secret_scan as S
from conftest import ODD

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)


def plain_base(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(k, a, b) for a, k, b in sorted(found)]


def test_base_patterns():
    rnd = random.Random(0)
    parts = ["token", "Secret", "API_KEY", "apikey", "paſſwd", "toKen", '"', "'", " ", ":", "=", "abc", "abcdef", "0" * 23, "f" * 24, "AKIA", "A" * 16, "é", "x=y"]
    for _ in range(4000):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 14)))
        assert S.base_spans(text) == plain_base(text)


def test_battery_is_uniform_on_random_strings_and_low_on_others():
    rnd = random.Random(1)
    strings = ["".join(rnd.choices("0123456789abcdef", k=40)) for _ in range(1500)]
    p = S.battery(strings, ["hex"] * len(strings))
    assert abs(np.mean(p < 0.1) - 0.1) < 0.04 and abs(np.mean(p < 0.5) - 0.5) < 0.06
    assert S.battery(["a1" * 20, "0123456789abcdef" * 3, "f" * 40], ["hex"] * 3).max() < 0.01


def test_inferred_encodings():
    assert [S.encoding_of(x) for x in ("0123", "0af1", "0AF1", "word", "XYZ7", "abz9", "ABZ9", "aB", "aB1", "a+/B1==")] == [
        "decimal", "hex", "upper_hex", "lower", "base32", "base36", "upper_base36", "letters", "base62", "base64",
    ]


def test_all_characters_of_candidates_can_be_tested():
    strings = ["123e4567-e89b-12d3-a456-426614174000", "ghp_16C7e42F292c6912E7710c838347Ae178B4a", "release-notes-2024", "a+/b0123456789AB==", "a+/b_0123456789AB"]
    encodings = [S.encoding_of(x) for x in strings]
    assert encodings == ["base64url", "base64url", "base64url", "base64", "base64_mixture"]
    p = S.battery(strings, encodings)
    assert ((p >= 0) & (p <= 1)).all()
    rnd = random.Random(3)
    for name in encodings[2:]:
        of_name = S.battery(["".join(rnd.choices(S.ENCODINGS[name], k=80)) for _ in range(800)], [name] * 800)
        assert abs(np.mean(of_name < 0.5) - 0.5) < 0.08


def test_texts_with_hyphens_and_underscores(spark):
    rows = [(1, "id 123e4567-e89b-12d3-a456-426614174000 in release-notes-2024"), (2, "ghp_16C7e42F292c6912E7710c838347Ae178B4a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert S.secrets(df).count() == 2 == S.redact(df).count()


def test_values_after_an_equals_sign_are_candidates():
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    forms = ["AWS_KEY={}", "https://x.org/a?sig={}&b=1", "DB_PASS={}\n", "export X={}==\n", 'k="{}"', "k: {}", "a=={}"]
    for form in forms:
        text = form.format(key)
        assert [text[a:b].rstrip("=") for a, b, _ in S._candidates(text) if key in text[a:b]] == [key], form


def test_rows_of_equal_length_have_the_same_p_values():
    rnd = random.Random(4)
    for name in ("lower", "decimal", "base64_mixture"):
        alphabet = S.ENCODINGS[name]
        strings = ["".join(rnd.choices(alphabet[: rnd.randint(1, len(alphabet))], k=24)) for _ in range(300)]
        rows = np.array([[alphabet.index(c) for c in x] for x in strings], np.int32)
        np.testing.assert_allclose(S.rows_battery(rows, len(alphabet)), S.battery(strings, [name] * 300), rtol=1e-6, atol=1e-12)


def test_ordinary_strings_are_all_of_the_text():
    text = "Many words, as they are. " * 1000 + "kq7Zx0pLw9Tt3Vb8Ny2R" * 500
    letters = 18 * 1000
    for parts in ([text], [text[: 25 * 600], text[25 * 600 :]]):
        counts = S._ordinary(parts)
        for of, length in enumerate(S.LENGTH_CLASSES):
            assert 0 <= letters // length - sum(c["n"] for c in counts if c["length_class"] == of) <= 1


def test_random_strings_of_few_long_texts_are_found(spark):
    rnd = random.Random(5)
    words = ["the", "and", "tion", "there", "other", "nothing", "in", "of"]
    chars = S.ENCODINGS["base62"]
    secrets = ["".join(rnd.choices(chars, k=60)) for _ in range(60)]
    texts = [" ".join(" ".join(rnd.choices(words, k=400)) + " " + x for x in secrets[i::3]) for i in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [texts[r.doc_id][s.start : s.end] for r in S.secrets(df).collect() for s in r.spans if s.kind == 3]
    assert set(found) <= set(secrets) and len(found) > 45
    assert sum("<secret>" in r.text for r in S.redact(df).collect()) == 3


def test_random_strings_of_letters_or_digits_alone_are_found(spark):
    rnd = random.Random(6)
    words = "the and nation there other nothing in of window harbour letter 1998 2004 2011 120 15 1000".split()
    lines = [" ".join(rnd.choices(words, k=3000)) for _ in range(40)]
    kinds = ["lower", "letters", "decimal", "upper_base36"]
    # From 24 digits on the base pattern of hex strings reports them.
    secrets = {k: ["".join(rnd.choices(S.ENCODINGS[k], k=23 if k == "decimal" else 80)) for _ in range(40)] for k in kinds}
    glued = ["".join(rnd.choices(words[:11], k=12)) for _ in range(40)]
    rows = [(i, " ".join([line, *(secrets[k][i] for k in kinds), glued[i], "-" * 60, "20" * 11])) for i, line in enumerate(lines)]
    texts = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {texts[r.doc_id][s.start : s.end] for r in S.secrets(df).collect() for s in r.spans if s.kind == 3}
    assert not found & {*glued, "-" * 60, "20" * 11}
    numbers = {k: sum(x in found for x in secrets[k]) for k in kinds}
    assert min(numbers.values()) > 20, numbers


def test_false_share_bounds_the_level():
    # Twenty others at level 1; ordinary strings are there one time in a thousand, or half of the time.
    assert S.limits_of([(3, 1, 1, 20), (3, 50, 999, 0)], 0.05) == {3: 1}
    assert S.limits_of([(0, 1, 500, 20), (0, 50, 500, 0)], 0.05) == {}
    assert S.limits_of([], 0.05) == {}


def test_random_strings_are_found_among_prose(spark):
    rnd = random.Random(2)
    prose = [" ".join(rnd.choices(["the", "and", "tion", "there", "other", "nothing", "in", "of"], k=120)) for _ in range(600)]
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secrets = ["".join(rnd.choices(chars, k=48)) for _ in range(100)]
    rows = [(i, t + (" " + secrets[i] + " tail" if i < 100 else "")) for i, t in enumerate(prose)]
    rows.append((1000, prose[0] + " " + "zzzzzzzz11111111" * 3))
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in S.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    found = [d for d in range(100) if any(k == 3 and texts[d][a:b] == secrets[d] for k, a, b in got[d])]
    assert len(found) > 60
    assert not any(got[d] for d in range(100, 600)) and got[1000] == []


def test_odd_rows(odd, nothing):
    assert sorted((str(r.doc_id), len(r.spans)) for r in S.secrets(odd).collect()) == sorted((str(d), 0) for d, _ in ODD)
    masked = S.redact(odd)
    assert masked.columns == odd.columns and sorted(map(str, masked.collect())) == sorted(map(str, odd.collect()))
    assert S.secrets(nothing).count() == 0 == S.redact(nothing).count()


def test_redaction_joins_overlapping_spans(spark):
    text = 'é token = "' + "0123456789abcdef" * 2 + '" end'
    row = S.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.text == 'é <secret>" end'


def test_query(spark):
    from runledger.llm.registry import queries

    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries()["op1_secret_scan"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for k, _, _ in base) for i in range(3)]
        said = ",".join(f"{S.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_query_counts_each_kind_wherever_it_stands(spark, tmp_path):
    from runledger.llm.registry import queries

    hexes, access, assign = "0f" * 12, "AKIA" + "B7" * 8, "token = abcdef"
    rnd = random.Random(7)
    texts = [None, "", hexes, access, f"{hexes} {assign}", f"{access} {hexes} {hexes} {assign}", f'é token: "{hexes}"', f"{assign} " * 3 + hexes]
    texts += [" ".join(rnd.choices([hexes, access, assign, "secret=short", "abc=1"], k=rnd.randint(0, 9))) for _ in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["op1_secret_scan"](spark, str(tmp_path))
    rows = found.collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id] or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for k, _, _ in base) for i in range(3)], texts[r.doc_id]
        said = ",".join(f"{S.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        kinds = [x.split(":")[0] for x in r.spans.split(",")]
        assert [r.n_assign, r.n_access, r.n_hex, r.n_random] == [kinds.count(k) for k in S.KINDS]
    assert found.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

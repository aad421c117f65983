import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from runledger.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, name string, end int, path int, depth int, n int, family int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """All nodes by a dictionary of prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[k] for k in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in children[p])
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(rebuilt[c]) == len(p)))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items()
    )


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5) for r in rows], SCHEMA)
    return sorted(tuple(-1 if x is None else x for x in r) for r in T.conversation_trie(df).select(*COLUMNS).collect())


def test_odd_rows(spark):
    rows = [
        (0, 1, "user", "one two"), (0, None, "user", "first of all"), (0, 2, None, None), (0, 3, "user", ""), (1, 0, "user", "a\x0bb\tc"), (2, 0, "use", "rx"),
        (3, 0, "user", "x"), (3, 0, "user", "x"), (None, 0, "user", "nobody"), (40, 0, "u", "word " * 50_000), (41, 0, "u", "w"), (59, 5, "u", "w"),
        (60, 0, "a", "b"), (61, 0, "a", "b"), (62, 0, "a", "b"), (65, 0, "", "ab"),
    ]
    assert run(spark, rows) == plain(rows)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


def test_only_turnless(spark):
    """Conversations that lose their only turn and find no family are members of the root alone."""
    rows = [(c, 0, "u", "w") for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4]
    assert run(spark, rows) == plain(rows) and len(plain(rows)) == 1


@pytest.mark.parametrize("longest", [1, 3, 20])
def test_against_dictionary(spark, longest):
    """Many shared prefixes of every length, equal conversations and one that holds most turns."""
    rng = np.random.default_rng(longest)
    rows = []
    for c in range(150):
        of = [(int(x), ("user", "assistant")[t % 2]) for t, x in enumerate(rng.integers(0, 2, rng.integers(1, longest + 1)))]
        rows += [(c, t, role, "word " * (x + 1)) for t, (x, role) in enumerate(of)]
    rows += [(7, 1_000 + t, "user", "more of it") for t in range(90)]
    rows += [(c, t, "user", f"same {t}") for c in range(5_000, 5_040) for t in range(min(longest, 5))]
    assert run(spark, rows) == plain(rows)


def test_ends_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 2)
    rows = [(c, t, "u", str(t)) for c in [*range(-9, 30), 1 << 40] for t in range(4)]
    assert run(spark, rows) == plain(rows)

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from runledger.llm import chat_format as C

TEXT = st.text(alphabet="ab \\[]</>INST\nsROLE:é", max_size=25)
ROLE = st.sampled_from(["user", "assistant", "system", "", "to[ol]\\"])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLE, TEXT), max_size=8))
def test_round_trip_and_spans(messages):
    whole = C.inst_template(messages)
    assert C.parse_turns(whole) == messages
    spans = C.turn_spans(C.inst_template, messages, [])
    assert "".join(s[0] for s in spans) == whole
    for (_, text), (added, a, b, rewritten) in zip(messages, spans, strict=True):
        assert not rewritten and C.unescape(added[a:b]) == text


def test_rewriting_templates_are_marked():
    def forgets(messages):
        return "|".join(text if i == len(messages) - 1 else "..." for i, (_, text) in enumerate(messages))

    def counts(messages):
        return "".join(f"<{len(messages)}>" if i == len(messages) - 1 else text for i, (_, text) in enumerate(messages))

    def looks_back(messages):
        return "".join(f"{i}:{text};" for i, (_, text) in enumerate(messages))

    messages = [("user", "one"), ("assistant", "two"), ("user", "three")]
    assert [s[3] for s in C.turn_spans(forgets, messages, [])] == [False, True, True]
    assert any(s[3] for s in C.turn_spans(counts, messages, []))
    # Numbers its turns: right as a whole, but not from the turn before alone.
    assert [s[3] for s in C.turn_spans(looks_back, messages, [])] == [False, False, True]


def digests(spark, rows, segment=C.SEGMENT):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start int, formatted string")
    return {r.conv_id: r for r in C.conversation_digests(C.format_conversations(df, segment=segment)).collect()}


def test_conversations(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {c} [INST] {t}", 1, "x") for c in range(5) for t in range(1 + 40 * c)]
    rows += [(None, 0, "user", "a", 1, "x"), (7, None, None, None, 1, "x"), (7, 1, "assistant", "b", 1, "x"), (7, 1, "assistant", "b", 1, "x")]
    for segment in (64, 7):
        got = digests(spark, rows, segment)
        assert set(got) == {0, 1, 2, 3, 4, 7, None}
        for c in range(5):
            own = [r for r in rows if r[0] == c]
            assert got[c].n_turns == len(own)
            assert got[c].turns_sha256 == sha("".join(f"{r[2]}\n{r[3]}\n" for r in own))
            assert got[c].loss_sha256 == sha("".join(r[3] for r in own if r[2] == "assistant"))
            assert got[c].loss_chars == sum(len(r[3]) for r in own if r[2] == "assistant")
            assert got[c].formatted_chars == len(C.inst_template([(r[2], r[3]) for r in own]))
        assert got[7].turns_sha256 == sha("\n\nassistant\nb\nassistant\nb\n") and got[7].loss_chars == 2
    assert digests(spark, rows[:1])[0].n_turns == 1


def test_places(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"t<{t}", 1, "x") for t in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start int, formatted string")
    whole = C.inst_template([(r[2], r[3]) for r in rows])
    for r in C.format_conversations(df, segment=4).collect():
        assert whole[r.start : r.start + len(r.formatted)] == r.formatted and not r.rewritten
        assert (r.loss_start is not None) == (r.role == "assistant")
        if r.loss_start is not None:
            assert C.unescape(whole[r.loss_start : r.loss_end]) == rows[r.turn_no][3]


def test_black_box_templates_see_the_whole_history(spark):
    def looks_back(messages):
        return "".join(f"{i}:{text};" for i, (_, text) in enumerate(messages))

    def moves_system(messages):
        system = "".join(text for role, text in messages if role == "system")
        last = max((i for i, (role, _) in enumerate(messages) if role == "user"), default=-1)
        return "".join(f"<{system}>{text};" if i == last else f"{text};" for i, (role, text) in enumerate(messages) if role != "system")

    def keeps_seventy(messages):
        return "".join(f"{text};" for _, text in messages[-70:])

    messages = [("system", "be kind"), *((("user", "assistant")[t % 2], f"turn {t}") for t in range(139))]
    df = spark.createDataFrame([(1, t, *m) for t, m in enumerate(messages)], "conv_id long, turn long, role string, text string")
    got = {f.__name__: sorted(C.format_conversations(df, f).collect(), key=lambda r: r.turn_no) for f in (looks_back, moves_system, keeps_seventy)}
    assert [r.formatted for r in got["looks_back"]] == [f"{i}:{text};" for i, (_, text) in enumerate(messages)]
    assert [r.rewritten for r in got["looks_back"]] == [i > 1 for i in range(140)]
    # Every user turn after the first takes the system text away from the one before.
    assert all(r.rewritten and "be kind" in r.formatted for r in got["moves_system"][2:] if r.role == "user")
    assert [r.turn_no for r in got["keeps_seventy"] if r.rewritten] == list(range(70, 140))
    for f in (looks_back, moves_system, keeps_seventy):
        spans = C.turn_spans(f, messages, [])
        assert [(r.formatted, r.rewritten) for r in got[f.__name__]] == [(s[0], s[3]) for s in spans]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.conversation_digests(C.format_conversations(empty)).count() == 0


def test_query(spark):
    from runledger.llm.registry import queries

    sf_dir = "/root/testdata/sf0.001"
    of = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        of.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in queries()["op5_chat_format"](spark, sf_dir).collect()}
    assert set(got) == set(of)
    for c, turns in of.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))

"""Chat formatting with a black-box template.

The template is a function from a list of (role, text) to a string; nothing else is known of it. Successive prefixes
of a conversation are rendered, and what each turn adds is the difference of consecutive outputs. Where an output does
not begin with the one before, the template rewrites history, and the turn is marked. Where a text lies within its
turn is found by rendering the turn with two probe texts.

Every turn is rendered with its whole history, so the work grows with the square of a conversation's length. Only a
``TurnTemplate``, which is the concatenation of its turns by construction, is rendered in segments of at most ``SEGMENT``
turns, each with the turn before it; its work grows with the length. Whether a turn looks the same with only the turn
before it as context is checked for every turn that has more; a template that looks further back is marked as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.storage import shuffle_partitions

Template = Callable[[list[tuple[str, str]]], str]
SEGMENT = 64
PROBES = ("x", "y")
_ESCAPED = re.compile(r"[\\\[<]")
_UNESCAPED = re.compile(r"\\(.)", re.DOTALL)
_BODY = r"[^\\\[<]*(?:\\.[^\\\[<]*)*"
_TURN = re.compile(
    rf"\[INST\] (?P<user>{_BODY}) \[/INST\]|\[(?P<role>ROLE):(?P<name>{_BODY})\[:\] (?P<other>{_BODY}) \[/ROLE\]| (?P<assistant>{_BODY}) </s>",
    re.DOTALL,
)
_TURNS = "conv_id long, turn_no long, role string, formatted string, start long, loss_start long, loss_end long, rewritten boolean"


def escape(text: str) -> str:
    """A backslash before every character that can begin a control string, and before backslashes."""
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class TurnTemplate:
    """A template that joins what ``turn`` gives for each (role, text) alone."""

    turn: Callable[[str, str], str]

    def __call__(self, messages: list[tuple[str, str]]) -> str:
        return "".join(self.turn(role, text) for role, text in messages)


def _inst_turn(role: str, text: str) -> str:
    """[INST] ... [/INST] around user texts, </s> after assistant texts, [ROLE:...] for all other roles."""
    body = escape(text)
    if role == "user":
        return f"[INST] {body} [/INST]"
    if role == "assistant":
        return f" {body} </s>"
    return f"[ROLE:{escape(role)}[:] {body} [/ROLE]"


inst_template = TurnTemplate(_inst_turn)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in the output of ``inst_template``."""
    turns, end = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != end:
            break
        end = m.end()
        if m["role"]:
            turns.append((unescape(m["name"]), unescape(m["other"])))
        else:
            role = "user" if m["user"] is not None else "assistant"
            turns.append((role, unescape(m[role])))
    if end != len(formatted):
        raise ValueError(f"no turn at character {end} of a formatted conversation")
    return turns


def _shared_end(a: str, b: str) -> int:
    return len(commonprefix([a[::-1], b[::-1]]))


def turn_spans(template: Template, messages: list[tuple[str, str]], seen: list[tuple[str, str]]) -> list[tuple[str, int, int, bool]]:
    """(added text, start and end of the message's text in it, rewritten) of each message after ``seen``."""
    rows = []
    before = template(seen) if seen else ""
    context = list(seen)
    for role, text in messages:
        now = template([*context, (role, text)])
        rewritten = not now.startswith(before)
        added = now[len(commonprefix([before, now])) :]
        if not rewritten and len(context) > 1:
            last = template(context[-1:])
            near = template([*context[-1:], (role, text)])
            rewritten = near[len(last) :] != added or not near.startswith(last)
        one, two = (template([*context, (role, probe)]) for probe in PROBES)
        head = max(0, len(commonprefix([one, two])) - (len(now) - len(added)))
        tail = _shared_end(one, two)
        rows.append((added, min(head, len(added)), max(head, len(added) - tail), rewritten))
        context.append((role, text))
        before = now
    return rows


def format_conversations(turns: DataFrame, template: Template = inst_template, segment: int = SEGMENT, loss_role: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, turn_no (from 0), role, formatted, start, loss_start, loss_end, rewritten.

    ``formatted`` is what the turn adds to its conversation, ``start`` its place there; loss_start and loss_end bound the text
    of a turn of ``loss_role`` in code points of the whole conversation, and are NULL for others and for rewritten turns.
    Rows are ordered by turn (NULL first), then role and text, so repeated turns stay as turns of their own. NULL
    text and role count as empty; rows with a NULL conv_id are one conversation. Other columns are ignored. A
    conversation is read in order by one task, a segment at a time; unless ``template`` is a TurnTemplate, the task holds its
    history and renders it with every turn. Rows stay in order within partitions.
    """
    local = isinstance(template, TurnTemplate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True)

        def done(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            names = ["conv_id", "turn_no", "role", "formatted", "start", "loss_start", "loss_end", "rewritten"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        out: list[tuple] = []
        held = 0
        for conv_id, own in groupby(rows(), key=lambda r: r[0]):
            seen: list[tuple[str, str]] = []
            at = number = 0
            while messages := [(role, text) for _, (_, role, text) in zip(range(segment), own, strict=False)]:
                for (role, _), (added, a, b, rewritten) in zip(messages, turn_spans(template, messages, seen), strict=True):
                    masked = role == loss_role and not rewritten
                    out.append((conv_id, number, role, added, at, at + a if masked else None, at + b if masked else None, rewritten))
                    at, number, held = at + len(added), number + 1, held + len(added)
                seen = messages[-1:] if local else seen + messages
                if held > 1_000_000:
                    yield done(out)
                    out, held = [], 0
        yield done(out)

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    ordered = (
        turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), *text)
        .repartition(shuffle_partitions(turns.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.mapInArrow(run, _TURNS)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the output says of each conversation, read back from it: n_turns, digests of its turns and of its loss text.

    ``formatted`` is the output of ``format_conversations`` with ``inst_template``, its rows in order within partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "start", "loss_start", "loss_end")), strict=True)

        found = []
        for conv_id, own in groupby(rows(), key=lambda r: r[0]):
            n = loss_chars = chars = 0
            turns, loss = hashlib.sha256(), hashlib.sha256()
            for _, added, start, a, b in own:
                for role, text in parse_turns(added):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                if a is not None:
                    text = unescape(added[a - start : b - start])
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    loss_chars += len(text)
                chars += len(added)
            found.append((conv_id, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        columns = list(zip(*found, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    kinds = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(run, kinds)

"""Secrets: fixed patterns, and strings that pass a battery of randomness tests.

Long strings without white space are tested for randomness over the alphabet of their inferred encoding:
chi-squared uniformity of the characters, number of runs above and below the middle, and serial correlation of
neighbours, combined into one p-value (Fisher). Every document also gives ordinary strings: the rest of its text, all of
it, cut into stretches of each length class; they tell how often text that is no secret looks that random. Strings of
digits are held against the digits of the texts, all others against their letters: the same letters look less random in
any larger alphabet. Within each encoding and length class the Benjamini-Hochberg rule on these empirical p-values sets
the level from which strings are reported, so short strings need stronger evidence than long ones, and glued words, which
are tested too, look as random as the letters they are held against.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.llm.batches import slices, texts_of
from runledger.llm.storage import stored

# The base patterns in the order of the kinds, and how long a match (of assign: its value) must be.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST_VALUE = 6

# Strings to test, how many levels of -log10 p are told apart, and the expected share of false reports.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
LENGTH_CLASSES = (16, 20, 24, 32, 48)
LEVELS = 100
# Ordinary strings that are tested at a time.
ROWS = 20_000
FALSE_SHARE = 0.01

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Encodings from the smallest alphabet to the largest; a string has the first that holds all its characters.
ENCODINGS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "upper_hex": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "upper_base36": _DIGITS + _UPPER,
    "letters": _UPPER + _LOWER,
    "base62": _UPPER + _LOWER + _DIGITS,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "base64_mixture": _UPPER + _LOWER + _DIGITS + "+/-_",
}
_LARGEST = max(map(len, ENCODINGS.values()))
NAMES = list(ENCODINGS)
CLASSES = len(NAMES) * len(LENGTH_CLASSES)
# Encodings that ordinary strings are tested in, and the bytes that are left out for each.
ORDINARY = {"decimal": bytes(set(range(256)) - set(_DIGITS.encode())), "lower": bytes(set(range(256)) - set((_LOWER + _UPPER).encode()))}
_SPAN = "struct<kind:int,start:long,end:long>"
_COUNT = "struct<encoding:int,length_class:int,level:int,n:long>"
_SCANNED = f"doc_id long, base array<{_SPAN}>, tested array<struct<start:long,end:long,class:int,level:int>>, ordinary array<{_COUNT}>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all matches of the base patterns that are long enough, by start and kind."""
    found = [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST_VALUE] if "=" in text or ":" in text else []
    found += [(1, *m.span()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def _chi_tail(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tail of the chi-squared distribution (Wilson-Hilferty)."""
    t = 2 / (9 * df)
    return _normal_tail(((x / df) ** (1 / 3) - (1 - t)) / np.sqrt(t))


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the normal distribution (complementary error function in Chebyshev form)."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]
    tail = 0.5 * t * np.exp(-x * x + np.polyval(poly, t))
    return np.where(z >= 0, tail, 1 - tail)


def encoding_of(string: str) -> str:
    body = set(string.rstrip("="))
    return next(name for name, alphabet in ENCODINGS.items() if body.issubset(alphabet))


def battery(strings: list[str], encodings: list[str]) -> np.ndarray:
    """Combined p-value of each string under the hypothesis that it is random over its encoding's alphabet."""
    if not strings:
        return np.zeros(0)
    size = np.array([len(ENCODINGS[e]) for e in encodings])
    places = {e: {c: i for i, c in enumerate(a)} for e, a in ENCODINGS.items()}
    bodies = [s.rstrip("=") for s in strings]
    values = np.concatenate([[places[e][c] for c in b] for b, e in zip(bodies, encodings, strict=True)]).astype(float)
    n = np.array([len(b) for b in bodies])
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    counts = np.zeros((len(n), _LARGEST))
    np.add.at(counts, (of, values.astype(int)), 1)
    inner = np.ones(len(values), bool)
    inner[first] = False
    sides = values * 2 >= (size - 1)[of]
    high = np.add.reduceat(sides.astype(float), first)
    runs = 1 + np.add.reduceat((inner & (sides != np.roll(sides, 1))).astype(float), first)
    centred = values - (np.add.reduceat(values, first) / n)[of]
    energy = np.add.reduceat(centred**2, first)
    cross = np.add.reduceat(centred * np.roll(centred, 1) * inner, first)
    return _combined(n, size, (counts**2).sum(1), high, runs, energy, cross)


def _combined(n, size, squares, high, runs, energy, cross) -> np.ndarray:
    """Fisher's p from the tests' statistics: squared character counts, places in the upper half, runs, (co)variation."""
    p_uniform = _chi_tail(squares / (n / size) - n, size - 1.0)
    low = n - high
    mean = 1 + 2 * high * low / n
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    p_runs = np.where(np.minimum(high, low) > 0, 2 * _normal_tail(np.abs(runs - mean) / spread), 2.0 ** (1 - n))
    serial = cross / np.maximum(energy, 1e-9)
    p_serial = np.where(energy > 0, 2 * _normal_tail(np.abs(serial + 1 / n) * np.sqrt(n)), 0.0)
    fisher = -2 * sum(np.log(np.clip(p, 1e-300, 1)) for p in (p_uniform, p_runs, p_serial))
    return _chi_tail(fisher, np.full(len(n), 6.0))


def rows_battery(places: np.ndarray, size: int) -> np.ndarray:
    """``battery`` for rows of equal length, given as places in an alphabet of ``size`` characters."""
    m, length = places.shape
    counts = np.bincount((places + np.arange(m, dtype=np.int32)[:, None] * size).ravel(), minlength=m * size).reshape(m, size)
    squares = np.einsum("ij,ij->i", counts, counts).astype(float)
    sides = places * 2 >= size - 1
    runs = 1.0 + (sides[:, 1:] != sides[:, :-1]).sum(1)
    total = places.sum(1).astype(float)
    mean = total / length
    energy = np.einsum("ij,ij->i", places, places) - total * mean
    ends = places[:, 0] + places[:, -1]
    cross = np.einsum("ij,ij->i", places[:, 1:], places[:, :-1]) - mean * (2 * total - ends) + (length - 1) * mean**2
    return _combined(np.full(m, length), np.full(m, size), squares, sides.sum(1).astype(float), runs, energy, cross)


def _candidates(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), m[0]) for m in CANDIDATE.finditer(text)]


def _ordinary(texts: list[str]) -> list[dict]:
    """How many stretches of the texts' digits and letters, candidates left out, have each level in each length class."""
    rest = [CANDIDATE.sub(" ", text).encode("ascii", "ignore").lower() for text in texts]
    found = []
    for name, left_out in ORDINARY.items():
        bodies, size, start = [x.translate(None, left_out) for x in rest], len(ENCODINGS[name]), ord(ENCODINGS[name][0])
        for of, length in enumerate(LENGTH_CLASSES):
            joined = np.frombuffer(b"".join(x[: len(x) // length * length] for x in bodies), np.uint8).reshape(-1, length)
            counts = np.zeros(LEVELS, np.int64)
            for i in range(0, len(joined), ROWS):
                counts += np.bincount(_levels(rows_battery(joined[i : i + ROWS].astype(np.int32) - start, size)), minlength=LEVELS)
            at = {"encoding": NAMES.index(name), "length_class": of}
            found += [{**at, "level": int(level), "n": int(counts[level])} for level in np.flatnonzero(counts)]
    return found


def _levels(p: np.ndarray) -> np.ndarray:
    return np.minimum(-np.log10(np.clip(p, 1e-300, 1)) * (LEVELS / 20), LEVELS - 1).astype(int)


def levels(strings: list[str], encodings: list[str]) -> list[int]:
    """Levels of -log10 p: 0 for a p-value near 1, the last for 1e-20 or less; higher is less random."""
    return _levels(battery(strings, encodings)).tolist()


def length_class(string: str) -> int:
    return bisect_right(LENGTH_CLASSES, len(string)) - 1


def class_of(string: str) -> int:
    return NAMES.index(encoding_of(string)) * len(LENGTH_CLASSES) + length_class(string)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
    item = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("class", pa.int32()), ("level", pa.int32())])
    count = pa.struct([("encoding", pa.int32()), ("length_class", pa.int32()), ("level", pa.int32()), ("n", pa.int64())])
    for part in (part for batch in batches for part in slices(batch)):
        texts = texts_of(part)
        strings = [(i, *found) for i, text in enumerate(texts) for found in _candidates(text)]
        tested: list[list[dict]] = [[] for _ in texts]
        at = levels([s[3] for s in strings], [encoding_of(s[3]) for s in strings])
        for (i, a, b, s), level in zip(strings, at, strict=True):
            tested[i].append({"start": a, "end": b, "class": class_of(s), "level": level})
        # The counts of all texts of the slice, on its first row.
        ordinary = [_ordinary(texts), *[[]] * (len(texts) - 1)]
        base = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in base_spans(text)] for text in texts]
        columns = [part.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(tested, pa.list_(item)), pa.array(ordinary, pa.list_(count))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "tested", "ordinary"])


def limits_of(counts: list[tuple[int, int, int, int]], false_share: float) -> dict[int, int]:
    """For each class the highest level to report, from (class, level, ordinary strings, others).

    Benjamini-Hochberg with the ordinary strings' chance of being at a level or below it: the largest level at which
    the reports expected by chance are at most ``false_share`` of all.
    """
    table = np.zeros((2, CLASSES, LEVELS))
    for of, level, ordinary, others in counts:
        table[:, of, level] += ordinary, others
    ordinary, others = table.cumsum(2)
    expected = (ordinary + 1) / (ordinary[:, -1:] + 1) * others[:, -1:]
    allowed = (table[1] > 0) & (expected <= false_share * others)
    return {c: int(np.flatnonzero(row)[-1]) for c, row in enumerate(allowed) if row.any()}


def _limits(scanned: DataFrame, false_share: float) -> dict[int, int]:
    """At most (CLASSES + 2 * LENGTH_CLASSES) * LEVELS counts go to the driver."""
    none = F.lit(-1)
    others = scanned.select(F.explode("tested").alias("t")).select("t.class", none.alias("encoding"), none.alias("length_class"), "t.level", F.lit(1).cast("long").alias("n"))
    plain = scanned.select(F.explode("ordinary").alias("o")).select(none.alias("class"), "o.encoding", "o.length_class", "o.level", "o.n")
    counts = []
    for of, encoding, length, level, n in others.unionByName(plain).groupBy("class", "encoding", "length_class", "level").agg(F.sum("n")).collect():
        if of >= 0:
            counts.append((of, level, 0, n))
        else:
            held = [e for e, name in enumerate(NAMES) if (name == "decimal") == (NAMES[encoding] == "decimal")]
            counts += [(e * len(LENGTH_CLASSES) + length, level, n, 0) for e in held]
    return limits_of(counts, false_share)


def _tested(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, _SCANNED)


def secrets(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id and ``spans``, an array of (kind, start, end) by start and kind.

    ``kind`` is a place in KINDS, places are code points, ends exclusive. Base patterns are reported as they match; a
    random string is reported beside them unless it lies within a base span. A NULL text is an empty one and has no
    spans; repeated rows are scanned each. Other columns are ignored.
    """
    scanned = stored(_tested(docs), "scanned")
    found = _limits(scanned, false_share)
    limits = F.array(*(F.lit(found.get(c, -1)) for c in range(CLASSES)))
    random = F.filter("tested", lambda t: t["level"] <= limits[t["class"]])
    new = F.filter(random, lambda t: ~F.exists("base", lambda b: (b.start <= t.start) & (t.end <= b.end)))
    as_spans = F.transform(new, lambda t: F.struct(t.start.alias("start"), F.lit(KINDS.index("random")).alias("kind"), t.end.alias("end")))
    base = F.transform("base", lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    by_start = F.array_sort(F.concat(base, as_spans))
    return scanned.select("doc_id", F.transform(by_start, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))).alias("spans"))


def redact(docs: DataFrame, false_share: float = FALSE_SHARE, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mark``; overlapping spans are replaced together.

    Rows and columns stay as they are; NULL texts stay NULL. Thresholds come from all rows of ``docs``.
    """
    limits = _limits(_tested(docs), false_share)
    at = docs.columns.index("text")

    def cut(text: str) -> str:
        strings = _candidates(text)
        spans = base_spans(text)
        found = levels([s[2] for s in strings], [encoding_of(s[2]) for s in strings])
        spans += [(KINDS.index("random"), a, b) for (a, b, s), level in zip(strings, found, strict=True) if level <= limits.get(class_of(s), -1)]
        out, end = [], 0
        for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
            if a >= end:
                out += [text[end:a], mark]
            end = max(end, b)
        return "".join([*out, text[end:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, at)):
            texts = [None if t is None else cut(t) for t in part.column(at).to_pylist()]
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)

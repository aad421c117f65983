"""Tokenizing whole texts with a cache of short units.

A public tokenizer never lets a token or a normalisation step reach over certain places in a text. The text
is cut at such places into units (mostly words), each distinct unit is encoded once, and the ids are put
together. The result is what the tokenizers library gives for the whole text.

Most new units are encoded by tiktoken from the vocabulary in the tokenizer's file, which is several times
faster. That merges by the rank of the result and not by pairs; both give the same ids if the file's ranks
follow its merges and every token encodes to itself (``merges_by_rank`` checks it). Units of characters on
which the libraries' Unicode tables might differ go to the tokenizers library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np

# Distinct units that a worker remembers, and the longest unit worth remembering.
REMEMBERED, LONGEST = 400_000, 64
WORD_END = "</w>"
# Splits of the two kinds of pre-tokenizer that are known here (fixed values of the tokenizers' files).
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# White space for Python but not for the tokenizers' patterns; and what other white space there is than " " and "\n".
_CONTROL = "\x1c\x1d\x1e\x1f"
_OTHER = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
_DOUBLE = ("  ", "\n\n", " \n", "\n ")
_SAFE = re.compile(r"(?<=\S)(?= \S)")
_PLAIN = re.compile(r"[ \n!-~À-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


# Odd multipliers per place in a unit, for two independent hashes; longer units go to the library.
_WEIGHTS = np.random.default_rng(0).integers(0, 2**63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)


def load(path: str):
    """A tokenizer without truncation or padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_table() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes as they are, others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _split_of(spec: dict) -> str | None:
    """WORD_SPLIT or BYTE_SPLIT if the file's steps are the ones known here."""
    pre, normalizer = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normalizer:
        return BYTE_SPLIT
    steps = [n["type"] for n in normalizer.get("normalizers", [])]
    patterns = [p.get("pattern", {}).get("Regex") for p in pre.get("pretokenizers", [])]
    if steps == ["NFC", "Replace", "Lowercase"] and patterns == [WORD_SPLIT, None] and spec["model"].get("end_of_word_suffix") == WORD_END:
        return WORD_SPLIT
    return None


def _reaches_itself(symbols: list[str], token: str, rank: dict[tuple[str, str], int]) -> bool:
    while len(symbols) > 1:
        best = min(range(len(symbols) - 1), key=lambda i: rank.get((symbols[i], symbols[i + 1]), len(rank)))
        pair = (symbols[best], symbols[best + 1])
        if pair not in rank:
            return False
        symbols[best : best + 2] = ["".join(pair)]
    return symbols == [token]


@cache
def merges_by_rank(path: str) -> bool:
    """Whether merging by the rank of the result gives the file's own encoding; run once, on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    suffix = model.get("end_of_word_suffix") or ""
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab, rank = model["vocab"], {m: i for i, m in enumerate(merges)}
    ids = [vocab["".join(m)] for m in merges]
    special = {t["content"] for t in spec["added_tokens"]}
    if _split_of(spec) is None or model.get("dropout") or model.get("ignore_merges") or any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
        return False
    merged = {"".join(m) for m in merges}
    for token, i in vocab.items():
        if token in merged:
            body, end = (token[: -len(suffix)], suffix) if suffix and token.endswith(suffix) else (token, "")
            if not _reaches_itself([*body[:-1], body[-1] + end], token, rank):
                return False
        elif token not in special and i >= ids[0]:
            return False
    return True


def _ranked(path: str):
    """A tiktoken encoding for the file's vocabulary; an end of word is written as a zero byte."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    table, special = byte_table(), {t["content"] for t in spec["added_tokens"]}
    suffix = spec["model"].get("end_of_word_suffix") or ""
    ranks = {}
    for token, i in spec["model"]["vocab"].items():
        if token not in special:
            body, end = (token[: -len(suffix)], b"\x00") if suffix and token.endswith(suffix) else (token, b"")
            ranks[bytes(table[c] for c in body) + end] = i
    return tiktoken.Encoding("ranked", pat_str=BYTE_SPLIT if not suffix else "[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})


def words(text: str) -> list[str]:
    """Units for a tokenizer that drops white space."""
    return [text] if any(map(text.__contains__, _CONTROL)) else text.split()


def spaced_words(text: str) -> list[str]:
    """Units for a byte-level tokenizer, where a token may begin with the one space before a word.

    A lone space or line break between other characters always begins a new piece.
    """
    has = text.__contains__
    if has("\x00") or any(map(has, _CONTROL)):
        return [text]
    if any(map(has, _DOUBLE)) or any(map(has, _OTHER)) or text[:1].isspace() or text[-1:].isspace():
        return _SAFE.split(text)
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")


class UnitEncoder:
    """Encodes texts into little-endian 32-bit ids."""

    def __init__(self, path: str, units: Callable[[str], list[str]], by_rank: bool = False):
        self.tokenizer = load(path)
        self.units = units
        self.known: dict[str, bytes] = {}
        self.ranked = _ranked(path) if by_rank else None
        if self.ranked is not None:
            sizes = np.zeros(self.ranked.max_token_value + 1, np.int64)
            ends = np.zeros(self.ranked.max_token_value + 1, bool)
            for token in self.ranked.token_byte_values():
                i = self.ranked.encode_single_token(token)
                sizes[i], ends[i] = len(token), token[-1:] == b"\x00"
            self.sizes, self.ends_piece = sizes, ends

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        return {u: np.array(self.tokenizer.encode(u, add_special_tokens=False).ids, "<u4").tobytes() for u in new}

    def _remembered(self, texts: list[str]) -> list[bytes]:
        """Through the tokenizers library, which sees each short unit once."""
        parts = [self.units(text) for text in texts]
        new = set(chain.from_iterable(parts)).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set(chain.from_iterable(parts))
        self.known.update(self._learn([u for u in new if len(u) <= LONGEST]))
        found = self.known | self._learn([u for u in new if len(u) > LONGEST])
        return [b"".join(map(found.__getitem__, units)) for units in parts]

    def _plain(self, text: str) -> bool:
        if self.ranked is None or not text or _PLAIN.fullmatch(text) is None or "<|" in text:
            return False
        if self.units is words:
            return "'" not in text
        return not (any(map(text.__contains__, _DOUBLE)) or text[0].isspace() or text[-1].isspace())

    def _distinct_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct plain units in a row, and where each unit's ids begin and end (one more than units)."""
        if self.units is words:
            # One call for all: each piece ends with an id that holds the end mark.
            pieces = [_PIECE.findall(unit.lower()) for unit in units]
            flat = np.array(self.ranked.encode_ordinary("".join([p + "\x00" for x in pieces for p in x])), "<u4")
            piece_ends = np.concatenate([[0], np.flatnonzero(self.ends_piece[flat]) + 1])
            return flat, piece_ends[np.cumsum([0, *map(len, pieces)])]
        # A line break and a unit's own leading space both separate it from its neighbours.
        flat = np.array(self.ranked.encode_ordinary("\n".join(units) + "\n"), "<u4")
        ends = np.cumsum(self.sizes[flat])
        sizes = np.array([len(unit.encode()) for unit in units])
        stops = np.searchsorted(ends, np.cumsum(sizes + 1) - 1) + 1
        keep = np.ones(len(flat), bool)
        keep[stops] = False
        return flat[keep], np.concatenate([[0], stops - np.arange(len(stops))])

    def _plain_ids(self, texts: list[str]) -> list[bytes] | None:
        """All texts at once: units are found and told apart in numpy, and each distinct one is encoded."""
        raws = [text.encode() for text in texts]
        raw = b"".join(raws)
        data = np.frombuffer(raw, np.uint8)
        doc_starts = np.cumsum([0, *map(len, raws)])
        line = data == 10
        begins = line | (data == 32)
        begins[1:] |= line[:-1]
        begins[doc_starts[:-1]] = True
        starts = np.flatnonzero(begins)
        sizes = np.diff(starts, append=len(data))
        if sizes.max() > len(_WEIGHTS[0]):
            return None
        at = np.arange(len(data)) - np.repeat(starts, sizes)
        key, other = (np.add.reduceat((data + np.uint64(1)) * w[at], starts) for w in _WEIGHTS)
        _, first, unit = np.unique(key, return_index=True, return_inverse=True)
        if (other != other[first][unit]).any():
            return None
        spans = zip(starts[first].tolist(), (starts[first] + sizes[first]).tolist(), strict=True)
        distinct = [raw[a:b].decode() for a, b in spans]
        breaks = [i for i, u in enumerate(distinct) if u == "\n"] if self.units is spaced_words else []
        if breaks:
            distinct[breaks[0]] = "a"  # encoded apart, below
        flat, bounds = self._distinct_ids(distinct)
        counts, place = np.diff(bounds), bounds[:-1].copy()
        if breaks:
            counts[breaks[0]], place[breaks[0]] = 1, len(flat)
            flat = np.append(flat, np.array(self.ranked.encode_ordinary("\n"), "<u4"))
        n = counts[unit]
        ends = np.cumsum(n)
        ids = flat[np.arange(ends[-1]) + np.repeat(place[unit] - (ends - n), n)].tobytes()
        cuts = np.concatenate([[0], 4 * ends])[np.searchsorted(starts, doc_starts)].tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, text in enumerate(texts) if self._plain(text)]
        done = self._plain_ids([texts[i] for i in plain]) if plain else []
        if done is None:
            plain, done = [], []
        found = dict(zip(plain, done, strict=True))
        rest = [i for i in range(len(texts)) if i not in found]
        found.update(zip(rest, self._remembered([texts[i] for i in rest]), strict=True))
        return [found[i] for i in range(len(texts))]

"""Words and lines of many texts at once, as numpy arrays over their joined UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Texts:
    """``data`` holds every text and a line break after it; text i is ``data[starts[i] : starts[i + 1] - 1]``."""

    data: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Texts:
        raws = [text.encode("utf-8", "replace") for text in texts]
        data = np.frombuffer(b"\n".join(raws) + b"\n" if raws else b"", np.uint8)
        return cls(data, np.cumsum([0, *(len(r) + 1 for r in raws)]))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of one value per byte for each text."""
        return np.add.reduceat(values, self.starts[:-1], dtype=np.int64)

    def lowered(self) -> np.ndarray:
        """The bytes with A-Z as a-z."""
        upper = (self.data >= 65) & (self.data <= 90)
        return self.data + (upper.view(np.uint8) << 5)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs in which ``inside`` holds."""
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of bytes that are no ASCII white space."""
    return spans((data != 32) & ((data < 9) | (data > 13)))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each of some ordered spans that do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64))
    values = (data[at + np.repeat(starts, sizes)] + np.uint64(1)) * powers[at]
    # An empty span has no sum of its own.
    sums = np.zeros(len(starts), np.uint64)
    full = sizes > 0
    sums[full] = np.add.reduceat(values, first[full])
    return mix(sums)

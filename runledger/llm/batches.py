"""Arrow batches in tasks, cut so that a few very long texts do not meet in one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

CHARACTERS = 4_000_000


def slices(batch: pa.RecordBatch, column: str | int = "text", most: int = CHARACTERS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts add up to about ``most`` bytes, or one longer text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str | int = "text") -> list[str]:
    """Texts as Python strings, NULL as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]

"""Time as a tree of buckets: an interval is a few nodes, an instant lies below one node of each level."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A node of a level covers so many of the level below.
RADIX = 32
_LEVEL = 1 << 40


def levels_for(buckets: int) -> int:
    """Levels with which an interval of so many buckets has at most 2 * (RADIX - 1) nodes a level."""
    levels = 1
    while buckets >= RADIX**levels:
        levels += 1
    return levels


def _range(first: Column, last: Column) -> Column:
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _numbered(nodes: Column, level: int) -> Column:
    return F.transform(nodes, lambda i: i + level * _LEVEL)


def covering_nodes(first: Column, last: Column, levels: int) -> Column:
    """The fewest nodes that cover the buckets from ``first`` to ``last`` and no other; one array.

    Of each level the nodes that lie inside, without those whose parent does.
    """
    parts = []
    lower = lambda k: F.ceil(first / RADIX**k)
    upper = lambda k: F.floor((last + 1) / RADIX**k) - 1
    for k in range(levels):
        low, high = lower(k), upper(k)
        nodes = _range(low, high)
        if k + 1 < levels:
            inner_low, inner_high = lower(k + 1) * RADIX, (upper(k + 1) + 1) * RADIX - 1
            outside = F.concat(_range(low, F.least(high, inner_low - 1)), _range(F.greatest(low, inner_high + 1), high))
            nodes = F.when(inner_low <= inner_high, outside).otherwise(nodes)
        parts.append(_numbered(nodes, k))
    return F.concat(*parts)


def nodes_above(bucket: Column, levels: int) -> Column:
    """The node of each level that a bucket lies in."""
    return F.array(*((F.floor(bucket / RADIX**k) + k * _LEVEL).cast("bigint") for k in range(levels)))

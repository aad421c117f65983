"""Display labels as plain column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger import fixed_values as V


def status_class(status: Column) -> Column:
    """success / error / warning / default."""
    upper = F.upper(status)
    chain = F
    for label, states in V.STATUS_CLASSES.items():
        chain = chain.when(upper.isin(*states), label)
    return chain.otherwise("default")


def duration_label(seconds: Column) -> Column:
    """Two most significant units; ``-`` when there is nothing to show."""
    whole = F.floor(seconds)
    hours, minutes = F.floor(seconds / 3600), F.floor((seconds % 3600) / 60)
    return (
        F.when(seconds.isNull() | (seconds == 0), F.lit("-"))
        .when(seconds < 60, F.format_string("%.0fs", seconds.cast("double")))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(seconds / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm", hours, minutes))
    )


def duration_label_short(seconds: Column) -> Column:
    """Most significant unit only, for dense grids."""
    return (
        F.when(seconds.isNull() | (seconds == 0), F.lit("-"))
        .when(seconds < 60, F.format_string("%.0fs", seconds.cast("double")))
        .when(seconds < 3600, F.format_string("%dm", F.floor(seconds / 60)))
        .otherwise(F.format_string("%dh", F.floor(seconds / 3600)))
    )


def sku_category(sku: Column) -> Column:
    """Product family of a SKU by ordered keyword rules."""
    upper = F.upper(F.coalesce(sku, F.lit("")))
    chain = F
    for label, groups in V.SKU_CATEGORIES:
        hits = (reduce(or_, (upper.contains(word) for word in words)) for words in groups)
        chain = chain.when(reduce(and_, hits), label)
    return chain.otherwise(V.SKU_OTHER)


def sku_short_label(sku: Column) -> Column:
    """Second and third word of a SKU, ``N/A`` when it has none."""
    words = F.concat_ws(" ", F.slice(F.split(sku, "_"), 2, 2))
    return F.coalesce(F.nullif(words, F.lit("")), F.lit("N/A"))

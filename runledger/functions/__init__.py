"""Column functions shared by the operators."""

from runledger.functions.labels import duration_label, duration_label_short, sku_category, sku_short_label, status_class
from runledger.functions.measures import as_event_time, as_id, epoch_second, is_bad, is_open, is_succeeded, pct, seconds_between, usd

__all__ = [
    "as_event_time",
    "as_id",
    "duration_label",
    "duration_label_short",
    "epoch_second",
    "is_bad",
    "is_open",
    "is_succeeded",
    "pct",
    "seconds_between",
    "sku_category",
    "sku_short_label",
    "status_class",
    "usd",
]

"""Job-run, cost and tag analytics expressed as lazy Spark DataFrame operators."""

from runledger.clock import Clock
from runledger.sources.tables import Tables

__all__ = ["Clock", "Tables"]

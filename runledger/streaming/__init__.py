"""Continuous ingestion of tag events."""

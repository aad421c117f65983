"""Derived tables and the reports built on them."""

"""Input tables: readers, shape checks and the adapter for the bundled test data."""

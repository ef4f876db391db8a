"""Column helpers, distributed scans and lineage utilities."""

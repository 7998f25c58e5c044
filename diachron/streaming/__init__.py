"""Incremental maintenance of the derived tables."""

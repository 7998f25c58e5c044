"""Readers, writers and adapters onto the paper / annotation data model."""

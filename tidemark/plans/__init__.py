"""Bindings to the given tables, the catalogue of queries, and their SQL."""

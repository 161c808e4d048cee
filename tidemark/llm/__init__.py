"""Operators for preparing large text corpora. Nothing outside this folder imports it, but for the guarded registration in ``__spark_entry__``."""

"""Streaming forms of the batch operators (not part of the batch behaviour)."""

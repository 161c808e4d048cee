"""Operators: DataFrames in, lazy DataFrames out."""

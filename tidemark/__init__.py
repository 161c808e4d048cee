"""Behavioural analytics, recommendation and reporting on PySpark DataFrames."""

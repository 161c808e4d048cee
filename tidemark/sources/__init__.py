"""Sources and sinks: CSV with explicit schemas, Parquet, model tables, and a synthetic clickstream."""

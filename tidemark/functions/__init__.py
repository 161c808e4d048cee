"""Column expressions used throughout the engine."""

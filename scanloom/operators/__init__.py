"""Operators: DataFrames in, DataFrames out, keyed by scan_id."""

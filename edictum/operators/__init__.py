"""Operators: each takes and returns DataFrames (or compiles to columns)."""

"""Aggregates, changes and nesting over DataFrames."""

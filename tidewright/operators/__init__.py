"""Public operators: conversions to DataFrames and files."""

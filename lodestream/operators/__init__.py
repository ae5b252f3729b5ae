"""Batch operators: DataFrames and parameters in, a DataFrame out, no files and no collected data."""

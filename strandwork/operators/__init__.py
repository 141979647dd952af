"""Relational operators. Each takes DataFrames and column names and returns a lazy DataFrame."""

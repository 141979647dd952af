"""Sequence, matching and operations analytics on PySpark DataFrames."""

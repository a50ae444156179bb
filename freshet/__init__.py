"""Hydrology analytics on Spark: DataFrames in, DataFrames out."""

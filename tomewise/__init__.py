"""Ratings and recommendations on Spark: DataFrames in, DataFrames out."""

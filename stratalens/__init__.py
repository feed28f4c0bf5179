"""Stratified audit analytics on PySpark: DataFrames in, DataFrames out."""

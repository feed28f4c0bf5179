"""Operators for training-corpus pipelines. Nothing else in the library imports this package."""

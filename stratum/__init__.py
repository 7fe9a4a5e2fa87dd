"""Sparse linear algebra and multilevel incomplete factorisation on Spark DataFrames."""

__version__ = "0.1.0"

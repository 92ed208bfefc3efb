"""Similarity of source code and text on Spark DataFrames."""

__version__ = "0.1.0"

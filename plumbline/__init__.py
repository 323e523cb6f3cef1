"""Bulk diagnosis of retrieval-augmented-generation runs on Spark DataFrames."""

__version__ = "0.1.0"

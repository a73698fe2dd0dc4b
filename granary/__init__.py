"""Granary: retrieval-and-evidence analytics expressed as Spark DataFrames."""

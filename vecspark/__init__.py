"""vecspark: vector collections, exact and approximate search, and clustering as Spark DataFrames."""

__version__ = "0.1.0"

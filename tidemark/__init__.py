"""Ordered, versioned key-value tables and related operators as Spark DataFrames."""

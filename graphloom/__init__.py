"""Subgraph matching and data preparation on Spark DataFrames."""

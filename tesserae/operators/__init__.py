"""Queries over the graph: DataFrames in, a DataFrame out."""

"""Operators of the evidence graph: DataFrames in, DataFrames out, batched over queries."""

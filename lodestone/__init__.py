"""Lodestone: an evidence-graph analytics engine on Spark DataFrames."""

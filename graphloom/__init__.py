"""Narrative knowledge-graph analytics on Spark DataFrames."""

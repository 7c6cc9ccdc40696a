"""Cohesive-subgraph analytics on similarity-augmented graphs, over Spark DataFrames."""

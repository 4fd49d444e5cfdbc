"""Judging and auditing retrieval-augmented and agent output with Spark DataFrames."""

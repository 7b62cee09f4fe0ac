"""Narrative text analytics on Spark DataFrames."""

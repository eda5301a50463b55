"""Tender analytics on Spark DataFrames."""

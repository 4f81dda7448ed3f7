"""Correspondence and text analytics on Spark DataFrames."""

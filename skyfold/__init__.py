"""Visibility analytics on Spark DataFrames."""

"""Temporal relational analytics on Spark DataFrames."""

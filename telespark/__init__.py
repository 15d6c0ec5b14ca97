"""Observability and cost analytics on Spark DataFrames."""

"""Paperloom: topic analytics and corpus preparation over Spark DataFrames."""

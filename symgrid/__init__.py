"""Semantic code-index engine and corpus tools on Spark DataFrames."""

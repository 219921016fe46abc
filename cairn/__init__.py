"""A small, strictly typed SQL engine on Spark DataFrames."""

"""News analytics on Spark DataFrames."""

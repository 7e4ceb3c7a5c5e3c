"""Entity masking analytics on Spark DataFrames."""

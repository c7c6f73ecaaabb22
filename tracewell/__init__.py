"""Document-source analytics on Spark DataFrames."""

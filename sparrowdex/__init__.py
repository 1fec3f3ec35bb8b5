"""Full-text search and index analytics on Spark DataFrames."""

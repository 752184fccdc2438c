"""File-tree analytics and corpus preparation on Spark DataFrames."""

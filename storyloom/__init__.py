"""Story-feed analytics on Spark: DataFrames in, DataFrames out."""

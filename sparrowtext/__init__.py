"""Full-text search and training-data preparation on Spark DataFrames."""

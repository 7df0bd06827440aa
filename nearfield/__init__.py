"""A vector-search and vector-analytics engine on Spark DataFrames."""

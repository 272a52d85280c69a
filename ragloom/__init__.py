"""A retrieval and text-analytics engine on Spark DataFrames."""

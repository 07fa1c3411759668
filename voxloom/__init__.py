"""A conversation-analytics engine on Spark DataFrames."""

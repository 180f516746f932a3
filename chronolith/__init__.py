"""Event and log analytics on Spark DataFrames."""

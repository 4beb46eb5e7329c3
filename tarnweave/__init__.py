"""Read-only property-graph analytics on Spark DataFrames."""

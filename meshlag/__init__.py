"""Station-mesh correlation engine on Spark DataFrames."""

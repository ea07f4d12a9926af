"""Analytics of three-dimensional routed networks on Spark DataFrames."""

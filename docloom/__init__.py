"""Document analytics on Spark: sources, functions, operators and plans over DataFrames."""

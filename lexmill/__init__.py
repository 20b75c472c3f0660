"""Document analytics on Spark: typed DataFrames in, ordinary Spark plans out."""

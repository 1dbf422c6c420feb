"""Code-graph analytics and source-corpus processing on Spark DataFrames."""

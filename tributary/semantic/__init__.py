"""Business models, metrics and structured queries, compiled to DataFrames."""

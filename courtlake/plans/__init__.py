"""Domain datasets as functions from DataFrames to DataFrames."""

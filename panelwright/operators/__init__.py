"""Panel operators: plain functions from DataFrames and a config to a DataFrame."""

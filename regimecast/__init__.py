"""Uncertainty-aware time-series analytics on Spark DataFrames."""

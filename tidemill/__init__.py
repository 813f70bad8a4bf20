"""Forecast-to-decision analytics on Spark DataFrames."""

"""Relational operators as functions from DataFrames to a DataFrame."""

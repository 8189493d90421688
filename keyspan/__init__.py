"""Versioned keyed datasets on Spark DataFrames."""

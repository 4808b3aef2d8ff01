"""Temporal ordering of events, time expressions and their links on Spark DataFrames."""

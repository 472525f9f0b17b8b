"""Relational operators of the catalogue: functions from DataFrames to DataFrames, no action inside."""

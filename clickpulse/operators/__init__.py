"""Operators: functions from DataFrames to a DataFrame, lazy and without collecting."""

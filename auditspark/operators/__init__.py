"""Operators: functions from DataFrames to DataFrames or columns."""

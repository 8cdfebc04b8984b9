"""Operators: functions from DataFrames to DataFrames. `now` and ids are always parameters."""

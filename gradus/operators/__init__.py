"""Operators: functions of DataFrames and Columns."""

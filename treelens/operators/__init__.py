"""Operators: functions from DataFrames to DataFrames; all carry project_id, so that many projects go through one job."""

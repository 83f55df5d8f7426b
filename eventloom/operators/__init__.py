"""Operators on event logs, process models and simulation parameters: DataFrame to DataFrame."""

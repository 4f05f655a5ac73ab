"""Operators on panels, portfolios, rankings and records: DataFrames in, DataFrames out."""

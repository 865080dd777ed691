"""Operators: DataFrames in, DataFrames out; only those that go in rounds run jobs of their own."""

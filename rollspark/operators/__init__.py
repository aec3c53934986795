"""Operators over rollout tables, all lazy: DataFrames in, DataFrames out."""

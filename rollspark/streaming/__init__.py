"""Structured Streaming versions of the step metrics."""

"""Readers and writers of rollout files."""

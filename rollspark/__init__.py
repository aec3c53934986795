"""Rollout analytics as lazy DataFrame operators."""

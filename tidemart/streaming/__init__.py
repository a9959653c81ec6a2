"""Stateful stream operators and the four streaming jobs."""

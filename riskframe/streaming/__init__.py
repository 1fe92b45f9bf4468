"""Scoring and evaluating rows as they arrive."""

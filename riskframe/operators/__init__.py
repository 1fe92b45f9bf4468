"""Operators from tables to prompts to scores to metrics; each takes and returns DataFrames or Columns."""

"""Registered queries, and the benchmark that runs a task from rows to results."""

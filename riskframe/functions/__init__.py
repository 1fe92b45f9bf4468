"""Scalar expressions, all evaluated by Spark itself."""

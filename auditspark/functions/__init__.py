"""Scalar functions: columns to columns."""

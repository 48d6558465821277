"""Scalar functions for display."""

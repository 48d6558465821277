"""Operators over cells."""

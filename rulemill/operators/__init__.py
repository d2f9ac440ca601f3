"""Operators of the rulebook corpus library."""

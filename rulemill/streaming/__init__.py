"""Streaming of the rulebook corpus library."""

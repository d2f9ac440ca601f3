"""Sources of the rulebook corpus library."""

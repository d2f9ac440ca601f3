"""Jobs of the rulebook corpus library."""

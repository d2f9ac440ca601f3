"""Functions of the rulebook corpus library."""

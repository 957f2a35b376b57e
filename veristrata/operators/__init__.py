"""operators of the core engine."""

"""sources of the core engine."""

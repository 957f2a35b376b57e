"""plans of the core engine."""

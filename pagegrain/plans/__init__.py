"""Plans of the engine: selectors and their compilation to DataFrame operations."""

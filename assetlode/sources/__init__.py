"""Sources of the inventory engine."""

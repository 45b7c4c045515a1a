"""Registered queries of the inventory engine."""

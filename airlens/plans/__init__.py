"""Registered queries over the given tables, with their comparison SQL."""

"""Operators put together, and the catalogue of checked queries."""

"""Operators put together, from input folders to results."""

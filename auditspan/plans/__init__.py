"""Operators put together: whole jobs."""

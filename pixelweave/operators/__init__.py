"""Operators from DataFrame to DataFrame, keyed by field of view (``fov``)."""

"""Fixture views over the driver's tables, and the SQL of the oracle."""

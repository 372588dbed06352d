"""Operators for preparing training data, with their queries and SQL."""

"""Operators that prepare training data, with their queries and SQL."""

"""Operators that a large training-data pipeline needs; nothing outside this subpackage imports it."""

"""Errors a statement can end in."""


class DialectError(Exception):
    """A statement that fails: its syntax, its names, its constraints or its values."""


class Unsupported(DialectError):
    """A statement of the dialect that this engine can't lower to Spark."""

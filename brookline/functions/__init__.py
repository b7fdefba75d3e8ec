"""Scalar functions on column expressions."""

from .scalars import add, equal, less, multiply, split_delimited, strip_quotes, subtract, trim_whitespace

__all__ = ["add", "equal", "less", "multiply", "split_delimited", "strip_quotes", "subtract", "trim_whitespace"]

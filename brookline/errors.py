"""Errors raised at plan time; those that depend on values are raised by Spark when an action runs."""


class SchemaError(ValueError):
    """A column is missing, repeated or of the wrong type."""


class OrderingError(ValueError):
    """A flow does not have the order that an operator was told to rely on."""


class PipelineError(ValueError):
    """A graph of flows can't be run: a name is missing, repeated or depends on itself."""


class FormatNotFound(ValueError):
    """No format belongs to this file name."""

"""Errors of the package."""


class TraceError(Exception):
    """Base of all errors raised here."""


class DataError(TraceError):
    """The input is malformed."""


class LimitError(TraceError):
    """The request is well formed but can't be fulfilled."""


class BugError(TraceError):
    """The package was used in a way it rules out."""

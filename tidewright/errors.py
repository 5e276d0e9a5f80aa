"""Errors that the public functions raise. Messages never hold payload bytes of the input."""

from __future__ import annotations


class TidewrightError(Exception):
    """Base of all errors of this package."""


class InvalidArgumentError(TidewrightError, ValueError):
    """An option or argument is not valid."""


class IntegrityError(TidewrightError):
    """The input is malformed, or breaks its contract."""


class ResourceError(TidewrightError):
    """A safety limit was exceeded."""


class OutOfMemoryError(ResourceError):
    """A memory limit was exceeded."""


class CancelledError(TidewrightError):
    """The operation was cancelled or ran out of time."""


class MissingDependencyError(TidewrightError, ImportError):
    """An optional library is not installed."""

"""Errors of the request surface."""


class EngineError(Exception):
    """Base of all errors that a caller can expect."""


class InvalidArgument(EngineError):
    """A request that contradicts itself or is out of its limits."""


class NotFound(EngineError):
    """A key that no row has."""


class Conflict(EngineError):
    """A row that exists already, or that has changed meanwhile."""


class Unsupported(EngineError):
    """A request that is known but not answered here."""

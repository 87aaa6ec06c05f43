"""Errors the engine raises."""


class EngineError(Exception):
    """Base of all errors of this package."""


class ConfigError(EngineError, ValueError):
    """A configuration is incomplete or holds a value out of range."""


class DimensionError(EngineError, ValueError):
    """Arrays do not fit each other."""


class MethodError(EngineError):
    """A reconstruction method is unknown or cannot work on its input."""


class SchemaError(EngineError, ValueError):
    """A file or table lacks columns or has rows that cannot be repaired."""

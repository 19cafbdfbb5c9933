"""Errors raised by the engine; everything a caller can get wrong is a ``ValueError``."""


class EngineError(Exception):
    """Base of all errors of this package."""


class SchemaError(EngineError, ValueError):
    """Bad input: wrong dimension, kind, metric, filter, ``k`` and the like."""


class StorageError(EngineError):
    """The stored files of a collection are missing, damaged or inconsistent."""


class TransactionError(EngineError, RuntimeError):
    """A transaction was opened inside another one, or used after its end."""

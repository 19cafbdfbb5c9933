"""Retrieval and analytics on Spark: keyed records with vectors, text and metadata."""

from .api import Collection, Hit, connect  # noqa: F401
from .errors import EngineError, SchemaError, StorageError, TransactionError  # noqa: F401
from .functions.vector import Metric  # noqa: F401

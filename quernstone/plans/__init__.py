"""Predicates: a small two-valued filter language compiled to Spark columns."""

from .predicate import (  # noqa: F401
    And, Compare, Eq, Everything, FaithfulMeta, Fields, In, Neq, Node, Not, NotPresent, Or, Present, Range,
    coerce_where, conjoin, filter_column, value_column,
)
from .where import parse_where  # noqa: F401

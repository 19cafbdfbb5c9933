"""Vector arithmetic as Spark columns.

All sums fold from left to right, so a result does not depend on partitioning. ``double``
(the default) adds in 64 bits; ``float`` keeps every step in 32 bits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column, functions as F

from ..errors import SchemaError


class Metric(Enum):
    """How two vectors are compared; a higher score is always the better one."""

    DOT = 0
    COSINE = 1
    L2 = 2

    @classmethod
    def of(cls, value: "Metric | str | int") -> "Metric":
        if isinstance(value, cls):
            return value
        if isinstance(value, str) and value.upper() in cls.__members__:
            return cls[value.upper()]
        if isinstance(value, int) and not isinstance(value, bool) and value in (0, 1, 2):
            return cls(value)
        raise SchemaError(f"unknown metric {value!r}: expected dot, cosine or l2")


def _zero(precision: str) -> Column:
    return F.lit(0.0).cast(precision)


def prefix(vector: Column, dims: int) -> Column:
    """The first ``dims`` elements (shorter vectors stay as they are)."""
    return F.slice(vector, 1, dims)


def dot(a: Column, b: Column, precision: str = "double") -> Column:
    """Sum of products; null if the lengths differ or an element is missing."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast(precision) * y.cast(precision))
    return F.aggregate(pairs, _zero(precision), lambda acc, x: acc + x)


def squared_distance(a: Column, b: Column, precision: str = "double") -> Column:
    def term(x: Column, y: Column) -> Column:
        d = x.cast(precision) - y.cast(precision)
        return d * d

    return F.aggregate(F.zip_with(a, b, term), _zero(precision), lambda acc, x: acc + x)


def norm(v: Column, precision: str = "double") -> Column:
    """Euclidean length; null for a null vector, 0 for an empty one."""
    squares = F.transform(v, lambda x: x.cast(precision) * x.cast(precision))
    return F.sqrt(F.aggregate(squares, _zero(precision), lambda acc, x: acc + x)).cast(precision)


def is_finite(v: Column) -> Column:
    """True if the vector is there and no element is null, NaN or infinite.

    Without a lambda: the search for infinity gives null, not false, if an element is null; NaN
    counts as the greatest element.
    """
    sound = ~F.array_contains(v, F.lit(math.inf)) & (F.array_min(v) > -math.inf) & ~F.isnan(F.array_max(v))
    return F.coalesce(F.when(F.size(v) == 0, F.lit(True)).otherwise(sound), F.lit(False))


def query_literal(query: Sequence[float], precision: str = "double") -> Column:
    return F.array(*[F.lit(float(x)).cast(precision) for x in query])


def check_query(query: Sequence[float], metric: Metric, dim: int | None = None) -> list[float]:
    """The query as floats; loud about empty, too long, non-finite and (cosine) zero ones."""
    q = [float(x) for x in query]
    if not q:
        raise SchemaError("query vector is empty")
    if dim is not None and len(q) > dim:
        raise SchemaError(f"query vector has {len(q)} elements, the collection only {dim}")
    if not all(map(math.isfinite, q)):
        raise SchemaError("query vector holds a non-finite element")
    if metric is Metric.COSINE and not any(q):
        raise SchemaError("cosine is undefined for a zero query vector")
    return q


def score(vector: Column, query: Sequence[float], metric: Metric, precision: str = "double") -> Column:
    """Score of one stored vector for a (possibly shorter) query.

    A shorter query compares with the stored vector's prefix, norms included. Null: cosine of
    a stored zero prefix, a null vector, or one shorter than the query.
    """
    q, stored = query_literal(query, precision), prefix(vector, len(query))
    if metric is Metric.DOT:
        raw = dot(stored, q, precision)
    elif metric is Metric.L2:
        raw = _zero(precision) - squared_distance(stored, q, precision)  # 0 - 0 is 0, not -0
    else:
        lengths = norm(stored, precision) * norm(q, precision)
        raw = F.when(lengths > 0, dot(stored, q, precision) / lengths)
    return F.when(F.size(stored) == len(query), raw).cast(precision)

"""Filter tree and its compilation to columns.

Rules: a metadata field is present or absent (null is absent); logic is two-valued; equality
minds the type (integer 1 is not float 1.0); ``!=`` holds for an absent field; ranges are for
numbers. A NaN field equals nothing and lies in no range.

Two field layouts are served. ``Fields``: each field is a typed column, so a filter reaches
the Parquet scan. ``FaithfulMeta``: one array of tagged structs, which alone can hold repeated
keys and a key whose type differs from record to record; any matching entry counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..errors import SchemaError

Value = bool | int | float | str | bytes
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1
EXACT = 2**53

#: Element type of the faithful layout: key, then one slot per kind.
META_TYPE = "array<struct<k:string,i:bigint,f:double,b:boolean,s:string,y:binary>>"


class Node:
    """A filter; combine with ``&``, ``|`` and ``~``."""

    def __and__(self, other: "Node") -> "Node":
        return conjoin(self, other)

    def __or__(self, other: "Node") -> "Node":
        return Or(self, other)

    def __invert__(self) -> "Node":
        return Not(self)


@dataclass(frozen=True)
class Everything(Node):
    """The empty filter."""


@dataclass(frozen=True)
class Eq(Node):
    field: str
    value: Value


@dataclass(frozen=True)
class Neq(Node):
    field: str
    value: Value


@dataclass(frozen=True)
class In(Node):
    field: str
    values: tuple[Value, ...]


@dataclass(frozen=True)
class Range(Node):
    """lo <= field <= hi. If both bounds are whole numbers, a float field must be whole too."""

    field: str
    lo: int | float
    hi: int | float


@dataclass(frozen=True)
class Compare(Node):
    """field ``<``, ``<=``, ``>`` or ``>=`` bound, truly strict for the strict signs."""

    field: str
    sign: str
    bound: int | float


@dataclass(frozen=True)
class Present(Node):
    field: str


@dataclass(frozen=True)
class NotPresent(Node):
    field: str


@dataclass(frozen=True)
class And(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Or(Node):
    left: Node
    right: Node


@dataclass(frozen=True)
class Not(Node):
    inner: Node


def conjoin(*nodes: Node) -> Node:
    """AND of the given filters; the empty filter is neutral."""
    return reduce(And, [n for n in nodes if not isinstance(n, Everything)] or [Everything()])


def kind_of(value: Any) -> str:
    """Slot letter of a literal: b, i, f, s or y. bool comes before int."""
    for kind, cls in (("b", bool), ("i", int), ("f", float), ("s", str), ("y", (bytes, bytearray))):
        if isinstance(value, cls):
            if kind == "i" and not LONG_MIN <= value <= LONG_MAX:
                raise SchemaError(f"integer {value} doesn't fit 64 bits")
            return kind
    raise SchemaError(f"unsupported metadata value {value!r}")


def _column_kind(dt: T.DataType) -> str | None:
    if isinstance(dt, T.BooleanType):
        return "b"
    if isinstance(dt, T.IntegralType):
        return "i"
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return "f"
    if isinstance(dt, T.StringType):
        return "s"
    return "y" if isinstance(dt, T.BinaryType) else None


_Test = Callable[[Column, str], "Column | None"]


class Fields:
    """Typed columns. ``columns`` maps a field name to its column name."""

    def __init__(self, schema: T.StructType, columns: Mapping[str, str] | None = None):
        types = {f.name: f.dataType for f in schema.fields}
        names = columns if columns is not None else {n: n for n in types}
        self._kinds = {f: (c, _column_kind(types[c])) for f, c in names.items()}

    @classmethod
    def of(cls, df: DataFrame, *exclude: str, prefix: str = "") -> "Fields":
        names = {c[len(prefix):]: c for c in df.columns if c.startswith(prefix) and c not in exclude}
        return cls(df.schema, names)

    def any_value(self, field: str, test: _Test) -> Column | None:
        """``test`` on the field's column; None if the field is unknown or of another kind."""
        name, kind = self._kinds.get(field, (None, None))
        return None if name is None or kind is None else test(F.col(f"`{name}`"), kind)

    def present(self, field: str) -> Column:
        name, _ = self._kinds.get(field, (None, None))
        return F.lit(False) if name is None else F.col(f"`{name}`").isNotNull()


class FaithfulMeta:
    """One column of type ``META_TYPE``."""

    def __init__(self, column: str = "meta"):
        self._column = F.col(column)

    def _exists(self, test: Callable[[Column], Column]) -> Column:
        return F.coalesce(F.exists(self._column, test), F.lit(False))

    def any_value(self, field: str, test: _Test) -> Column | None:
        def entry(e: Column) -> Column:
            tests = [t for k in "ifbsy" if (t := test(e[k], k)) is not None]
            return F.coalesce((e["k"] == field) & reduce(Column.__or__, [F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False))

        return self._exists(entry) if any(test(F.lit(None), k) is not None for k in "ifbsy") else None

    def present(self, field: str) -> Column:
        return self._exists(lambda e: F.coalesce(e["k"] == field, F.lit(False)))


def _equals(value: Value) -> _Test:
    kind = kind_of(value)

    def test(c: Column, k: str) -> Column | None:
        if k != kind or (kind == "f" and math.isnan(value)):
            return None
        return c.eqNullSafe(F.lit(bytearray(value)) if kind == "y" else F.lit(value))

    return test


def _one_of(kind: str, values: list[Value]) -> _Test:
    """One IN over all values of a kind: it stays one node for Catalyst and reaches the scan."""
    sound = [v for v in dict.fromkeys(bytes(v) if kind == "y" else v for v in values) if not (kind == "f" and math.isnan(v))]

    def test(c: Column, k: str) -> Column | None:
        return c.isin([F.lit(bytearray(v)) if kind == "y" else F.lit(v) for v in sound]) if k == kind and sound else None

    return test


def _bounded(lo: int | float | None, hi: int | float | None, strict_lo: bool = False, strict_hi: bool = False, whole: bool = False) -> _Test:
    """lo/hi None: open. Integer columns are compared with integers, never through doubles."""

    def test(c: Column, k: str) -> Column | None:
        if k == "i":
            low = LONG_MIN if lo is None or lo == -math.inf else (LONG_MAX + 1 if lo == math.inf else math.floor(lo) + 1 if strict_lo else math.ceil(lo))
            high = LONG_MAX if hi is None or hi == math.inf else (LONG_MIN - 1 if hi == -math.inf else math.ceil(hi) - 1 if strict_hi else math.floor(hi))
            if low > high or low > LONG_MAX or high < LONG_MIN:
                return F.lit(False)
            parts = [c >= F.lit(max(low, LONG_MIN)).cast("long")] * (low > LONG_MIN) + [c <= F.lit(min(high, LONG_MAX)).cast("long")] * (high < LONG_MAX)
            return reduce(Column.__and__, parts) if parts else c.isNotNull()
        if k != "f":
            return None
        parts = [~F.isnan(c)]
        if lo is not None:
            parts.append(c > F.lit(float(lo)) if strict_lo else c >= F.lit(float(lo)))
        if hi is not None:
            parts.append(c < F.lit(float(hi)) if strict_hi else c <= F.lit(float(hi)))
        if whole:
            parts += [F.floor(c).cast("double") == c, F.abs(c) <= F.lit(float(EXACT))]
        return reduce(Column.__and__, parts)

    return test


def _check_bound(x: Any) -> int | float:
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise SchemaError(f"range bound must be int or float, not {x!r}")
    if isinstance(x, float) and math.isnan(x):
        raise SchemaError("range bound is NaN")
    return x


def _is_whole(x: int | float) -> bool:
    return isinstance(x, int) or (math.isfinite(x) and x == math.floor(x) and abs(x) <= EXACT)


def _leaf(node: Node, fields: Fields | FaithfulMeta) -> tuple[Column | None, bool]:
    """The positive test of a leaf (None: never true) and whether the leaf negates it."""
    if isinstance(node, (Eq, Neq)):
        return fields.any_value(node.field, _equals(node.value)), isinstance(node, Neq)
    if isinstance(node, In):
        tests = [t for kind in dict.fromkeys(map(kind_of, node.values)) if (t := fields.any_value(node.field, _one_of(kind, [v for v in node.values if kind_of(v) == kind]))) is not None]
        return (reduce(Column.__or__, tests) if tests else None), False
    if isinstance(node, Range):
        lo, hi = _check_bound(node.lo), _check_bound(node.hi)
        if lo > hi:
            return None, False
        return fields.any_value(node.field, _bounded(lo, hi, whole=_is_whole(lo) and _is_whole(hi))), False
    if isinstance(node, Compare):
        b, low = _check_bound(node.bound), node.sign[0] == ">"
        strict = len(node.sign) == 1
        test = _bounded(b, None, strict_lo=strict) if low else _bounded(None, b, strict_hi=strict)
        return fields.any_value(node.field, test), False
    if isinstance(node, (Present, NotPresent)):
        return fields.present(node.field), isinstance(node, NotPresent)
    raise SchemaError(f"not a filter: {node!r}")


def value_column(node: Node, fields: Fields | FaithfulMeta) -> Column:
    """The filter as a boolean column that is never null."""
    return _compile(node, fields, bare=False)


def filter_column(node: Node, fields: Fields | FaithfulMeta) -> Column:
    """The filter for use in ``where``: null where false will do, so that it can be pushed down."""
    return _compile(node, fields, bare=True)


def _compile(node: Node, fields: Fields | FaithfulMeta, bare: bool) -> Column:
    if isinstance(node, Everything):
        return F.lit(True)
    if isinstance(node, And):
        return _compile(node.left, fields, bare) & _compile(node.right, fields, bare)
    if isinstance(node, Or):
        return _compile(node.left, fields, bare) | _compile(node.right, fields, bare)
    if isinstance(node, Not):
        return ~_compile(node.inner, fields, bare=False)
    test, negated = _leaf(node, fields)
    if test is None:
        return F.lit(negated)
    if negated or not bare:
        test = F.coalesce(test, F.lit(False)) if isinstance(node, (In, Range, Compare)) else test
    return ~test if negated else test


def _from_spec(spec: Any) -> Node:
    if not isinstance(spec, Mapping):
        raise SchemaError("each filter of a list must be a dict")
    try:
        if "eq" in spec:
            return Eq(spec["eq"]["field"], spec["eq"]["value"])
        if "in" in spec:
            return In(spec["in"]["field"], tuple(spec["in"]["values"]))
        if "range" in spec:
            r = spec["range"]
            return Range(r["field"], _check_bound(r["lo"]), _check_bound(r["hi"]))
        if "present" in spec:
            return Present(spec["present"])
    except (KeyError, TypeError) as e:
        raise SchemaError(f"malformed filter {spec!r}") from e
    raise SchemaError("a filter of a list needs one of: eq, in, range, present")


def coerce_where(where: Any) -> Node:
    """None, a where-string, ``{field: value}``, a list of filter dicts, or a ``Node``."""
    from .where import parse_where

    if where is None:
        return Everything()
    if isinstance(where, Node):
        return where
    if isinstance(where, str):
        return parse_where(where)
    if isinstance(where, Mapping):
        for v in where.values():
            kind_of(v)
        return conjoin(*[Eq(str(k), v) for k, v in where.items()])
    if isinstance(where, (list, tuple)):
        return conjoin(*map(_from_spec, where))
    raise SchemaError("where must be a string, a dict, a list of filter dicts or a filter")

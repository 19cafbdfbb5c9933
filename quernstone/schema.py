"""Record schema, collection settings and checks of incoming rows."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .errors import SchemaError
from .functions.vector import Metric, is_finite
from .plans.predicate import META_TYPE, kind_of

UPSERT, DELETE = "upsert", "delete"
ID_KINDS = {"int": "bigint", "str": "string"}
MAX_DIM = 65_535
#: Limit of metadata keys, strings and byte strings.
MAX_META_BYTES = 65_535


@dataclass
class Settings:
    """What a collection fixes once: dimension, id kind, metric, and how metadata is stored.

    ``fields`` maps metadata names to Spark types (typed columns, named ``m_<field>``); None
    keeps metadata in one array of tagged structs that holds anything.
    """

    dim: int | None = None
    id_kind: str | None = None
    metric: str | None = None
    fields: dict[str, str] | None = None
    pruned: bool = False

    def to_json(self) -> dict[str, Any]:
        return asdict(self)

    def meta_columns(self) -> list[str]:
        return ["meta"] if self.fields is None else [f"m_{f}" for f in self.fields]

    def row_type(self) -> str:
        meta = f"meta {META_TYPE}" if self.fields is None else ", ".join(f"`m_{f}` {t}" for f, t in self.fields.items())
        return ", ".join(filter(None, [f"id {ID_KINDS[self.id_kind or 'int']}", "vector array<float>", "norm float", "text string", meta]))


def id_kind_of(values: Iterable[Any]) -> str:
    kinds = set()
    for v in values:
        if isinstance(v, bool) or not isinstance(v, (int, str)):
            raise SchemaError(f"an id must be an integer or a string, not {v!r}")
        if isinstance(v, int) and not 0 <= v < 2**63:
            raise SchemaError(f"integer id {v} is negative or too large")
        kinds.add("int" if isinstance(v, int) else "str")
    if len(kinds) > 1:
        raise SchemaError("integer and string ids can't be mixed")
    return kinds.pop() if kinds else "int"


def tagged(meta: Mapping[str, Any] | Sequence[tuple[str, Any]] | None) -> list[tuple]:
    """Metadata as tagged entries. Pairs may repeat a key; None values are absent fields."""
    entries = []
    for k, v in (meta.items() if isinstance(meta, Mapping) else meta or ()):
        if v is None:
            continue
        kind = kind_of(v)
        if len(str(k).encode()) > MAX_META_BYTES or (kind in "sy" and len(v.encode() if kind == "s" else v) > MAX_META_BYTES):
            raise SchemaError(f"metadata field {str(k)[:40]!r} is too long")
        entries.append((str(k), *[(bytearray(v) if kind == "y" else v) if kind == slot else None for slot in "ifbsy"]))
    return entries


def rows_from_columns(spark: SparkSession, settings: Settings, ids: Sequence, vectors: Sequence, text: Sequence | None, metadata: Sequence | None, norms: Sequence | None = None) -> DataFrame:
    """DataFrame of one batch given as parallel lists; lengths must agree."""
    n = len(ids)
    for name, column in (("vectors", vectors), ("text", text), ("metadata", metadata), ("norms", norms)):
        if column is not None and len(column) != n:
            raise SchemaError(f"{name} has {len(column)} entries for {n} ids")
    out = []
    for i in range(n):
        meta = metadata[i] if metadata is not None else None
        if settings.fields is None:
            cells = [tagged(meta)]
        else:
            given = dict(meta or {})
            if unknown := set(given) - set(settings.fields):
                raise SchemaError(f"metadata fields {sorted(unknown)} aren't in the collection's schema")
            cells = [given.get(f) for f in settings.fields]
        vector = None if vectors[i] is None else [float(x) for x in vectors[i]]
        norm = None if norms is None or norms[i] is None else float(norms[i])
        if norm is not None and not math.isfinite(norm):
            raise SchemaError("norm is not finite")
        out.append((ids[i], vector, norm, text[i] if text is not None else None, *cells))
    try:
        return spark.createDataFrame(out, settings.row_type()).coalesce(1)
    except (TypeError, ValueError) as e:
        raise SchemaError(f"batch doesn't fit the collection's schema: {e}") from e
    except Exception as e:  # PySparkTypeError and the like
        raise SchemaError(f"batch doesn't fit the collection's schema: {e}") from e


def violation_counts(settings: Settings) -> list[Column]:
    """Aggregates over a batch: its dimensions and how many upsert rows are faulty, by kind.

    They are observed while the batch is written, before anything becomes visible: null id,
    negative id, missing, empty, too long or wrong-length vector, non-finite element or norm.
    """
    up, size = F.col("op") == UPSERT, F.size("vector")
    faults = {"null id": F.col("id").isNull(), "negative id": F.col("id").cast("string").startswith("-") & F.lit(settings.id_kind == "int"),
              "missing, empty or too long vector": up & (F.col("vector").isNull() | (size < 1) | (size > MAX_DIM)),
              "non-finite vector element": up & ~is_finite(F.col("vector")), "non-finite norm": up & (F.isnan("norm") | (F.abs("norm") == math.inf))}
    return [F.min(F.when(up, size)).alias("lo"), F.max(F.when(up, size)).alias("hi"), *[F.sum(f.cast("long")).alias(name) for name, f in faults.items()]]


def verdict(counts: Mapping[str, int | None], settings: Settings) -> tuple[dict[str, int], int | None]:
    """Faults of a batch with their counts, and its dimension, from what was observed."""
    counts = dict(counts)
    lo, hi = counts.pop("lo", None), counts.pop("hi", None)
    want = settings.dim if settings.dim is not None else hi
    faults = {k: v for k, v in counts.items() if v}
    if lo is not None and (lo != want or hi != want):
        faults["wrong dimension"] = 1
    return faults, want


def check_metric(name: str) -> str:
    return Metric.of(name).name.lower()

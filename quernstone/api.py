"""The collection as users see it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import SchemaError, TransactionError
from .functions.vector import Metric, check_query
from .operators.ann import IvfConfig, IvfIndex, indexed_search
from .operators.bm25 import text_top_k
from .operators.fusion import RRF_K, rrf
from .operators.liveview import batch_get, point_get
from .operators.topk import check_k, exact_top_k
from .plans.predicate import FaithfulMeta, Fields, coerce_where, filter_column
from .schema import UPSERT, check_metric, id_kind_of, rows_from_columns
from .sources.store import LEASE_S, Store


@dataclass(frozen=True)
class Hit:
    """One search result on the driver."""

    id: int | str
    score: float
    seq: int


def connect(spark: SparkSession, folder: str, *, metric: str | None = None, fields: dict[str, str] | None = None, safety: str = "strict", autocommit: bool = True, lease_s: float = LEASE_S) -> "Collection":
    """Opens or creates the collection in ``folder``.

    ``fields`` declares typed metadata columns for a new collection; without it metadata may hold
    anything. ``safety`` is ``strict`` (every commit is on storage before it returns). ``lease_s``:
    how old what a checkpoint removes must be, so that no open reader or writer misses it.
    """
    if safety != "strict":
        raise SchemaError(f"safety {safety!r} isn't offered; use 'strict'")
    c = Collection(spark, folder, fields=fields, autocommit=autocommit, lease_s=lease_s)
    if metric is not None:
        c.set_metric(metric)
    return c


class Collection:
    """Keyed records (vector, text, metadata) with exact, approximate, text and hybrid search.

    Searches return lazy DataFrames (id, score, seq); ``hits`` brings a result to the driver.
    Equal scores order by id. Writes commit by themselves unless inside ``transaction()``.
    """

    def __init__(self, spark: SparkSession, folder: str, fields: dict[str, str] | None = None, autocommit: bool = True, lease_s: float = LEASE_S):
        self.spark, self.store, self.autocommit = spark, Store(spark, folder, lease_s), autocommit
        self._in_transaction, self._index, self._index_config = False, None, IvfConfig()
        s = self.store.settings
        if fields is not None:
            if s.id_kind is not None and s.fields != fields:
                raise SchemaError("the collection exists with other metadata fields")
            s.fields = dict(fields)

    # -- settings ------------------------------------------------------------------------

    @property
    def dim(self) -> int | None:
        return self.store.settings.dim

    @property
    def id_kind(self) -> str | None:
        return self.store.settings.id_kind

    @property
    def metric(self) -> str | None:
        return self.store.settings.metric

    def set_metric(self, metric: str) -> None:
        """Fixes the metric; again with the same one is fine, with another an error."""
        name = check_metric(metric)
        if self.metric not in (None, name):
            raise SchemaError(f"the metric is {self.metric} and can't become {name}")
        self.store.settings.metric = name
        self.store.save_settings()

    def _metric(self, metric: str | Metric | None) -> Metric:
        return Metric.of(metric if metric is not None else self.metric or "l2")

    # -- writes --------------------------------------------------------------------------

    def add(self, ids: Sequence, vectors: Sequence, text: Sequence | None = None, metadata: Sequence | None = None, norms: Sequence | None = None) -> int:
        """Adds or replaces whole records, given as parallel lists; returns the last seq.

        Of an id that comes twice the later one stands. The batch is all or nothing.
        """
        if not len(ids):
            raise SchemaError("nothing to add")
        self._lock_kind(id_kind_of(ids))
        return self._write(rows_from_columns(self.spark, self.store.settings, ids, vectors, text, metadata, norms))

    def add_frame(self, rows: DataFrame) -> int:
        """The same from a DataFrame with id, vector and, as wanted, norm, text and metadata columns."""
        kind = {"bigint": "int", "int": "int", "string": "str"}.get(rows.schema["id"].dataType.simpleString())
        if kind is None:
            raise SchemaError("ids must be integers or strings")
        self._lock_kind(kind)
        cols = [c.strip().split(" ", 1) for c in self.store.settings.row_type().replace("`", "").split(", ")]
        return self._write(rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(t).alias(n) for n, t in cols]))

    def upsert(self, id: int | str, vector: Sequence[float], text: str | None = None, metadata: dict | None = None, norm: float | None = None) -> int:
        return self.add([id], [vector], [text], [metadata], [norm])

    def delete(self, ids: Any) -> int:
        """Deletes one id or a non-empty list; an unknown id refuses all."""
        ids = list(ids) if isinstance(ids, (list, tuple, set)) else [ids]
        if not ids:
            raise SchemaError("nothing to delete")
        if id_kind_of(ids) != (self.id_kind or id_kind_of(ids)):
            raise SchemaError(f"ids of this collection are {self.id_kind}")
        kind = "bigint" if id_kind_of(ids) == "int" else "string"
        seq = self.store.delete(self.spark.createDataFrame([(i,) for i in ids], f"id {kind}").coalesce(1))
        return self._done(seq)

    def _lock_kind(self, kind: str) -> None:
        if self.id_kind not in (None, kind):
            raise SchemaError(f"ids of this collection are {self.id_kind}")
        self.store.settings.id_kind = kind

    def _write(self, rows: DataFrame) -> int:
        return self._done(self.store.stage(rows, UPSERT))

    def _done(self, seq: int) -> int:
        if self.autocommit and not self._in_transaction:
            self.store.commit()
        return seq

    def commit(self) -> int:
        return self.store.commit()

    def rollback(self) -> None:
        self.store.rollback()

    @contextmanager
    def transaction(self) -> Iterator["Collection"]:
        """Commits at the end of the block, rolls back if it raises."""
        if self._in_transaction:
            raise TransactionError("a transaction is already open")
        if self.store.staged:
            raise TransactionError("uncommitted writes precede the transaction")
        self._in_transaction = True
        try:
            yield self
            self.store.commit()
        except BaseException:
            self.store.rollback()
            raise
        finally:
            self._in_transaction = False

    def checkpoint(self, prune_log: bool = False, index: bool = True) -> int:
        """Compacts to a snapshot and, for l2 and cosine, builds its index."""
        if self._in_transaction:
            raise TransactionError("can't checkpoint inside a transaction")
        generation = self.store.checkpoint(prune_log)
        self._index = None
        if index and self.dim and self._metric(None) is not Metric.DOT and self.store.snapshot_rows > self._index_config.exact_below:
            rows = self.store._read_snapshot().select("id", "seq", "vector")
            IvfIndex.build(rows, self._index_folder(), self._metric(None), self.dim, self._index_config)
        return generation

    def _index_folder(self) -> str:
        return f"{self.store.folder}/index/{self.store.snapshot}"

    # -- reads ---------------------------------------------------------------------------

    def frame(self) -> DataFrame:
        """Live records as a DataFrame, in no order."""
        return self.store.live()

    def scan(self) -> DataFrame:
        """Live records in seq order."""
        return self.frame().orderBy("seq")

    def __len__(self) -> int:
        return self.frame().count()

    def is_empty(self) -> bool:
        return self.frame().isEmpty()

    def is_live(self, id: int | str) -> bool:
        return not point_get(self.frame(), "id", id).isEmpty()

    def get(self, ids: Any) -> Any:
        """Record of one id as a dict (or None); for a list of several ids a list in that order."""
        many = isinstance(ids, (list, tuple))
        asked = list(ids) if many else [ids]
        if not asked:
            return []
        if self.id_kind is None or id_kind_of(asked) != self.id_kind:
            found = [None] * len(asked)
        else:
            found = [self._record(r) for r in batch_get(self.frame(), "id", asked).collect()]  # as many rows as asked
        return found if many and len(asked) > 1 else found[0]

    def _record(self, row) -> dict | None:
        if row["seq"] is None:
            return None
        s = self.store.settings
        if s.fields is None:
            meta = {e["k"]: next((e[k] for k in "ifbsy" if e[k] is not None), None) for e in row["meta"] or []}
        else:
            meta = {f: row[f"m_{f}"] for f in s.fields if row[f"m_{f}"] is not None}
        return {"external_id": row["id"], "vector": row["vector"], "text": row["text"], "norm": row["norm"], "meta": meta}

    def _where(self, where: Any):
        fields = FaithfulMeta() if self.store.settings.fields is None else Fields(self.frame().schema, {f: f"m_{f}" for f in self.store.settings.fields})
        return filter_column(coerce_where(where), fields)

    def exact_search(self, query: Sequence[float], k: int, metric: str | None = None, where: Any = None) -> DataFrame:
        """Exact ranking of the live records that pass ``where``; see ``exact_top_k``."""
        rows = self.frame() if where is None else self.frame().where(self._where(where))
        return exact_top_k(rows, query, k, self._metric(metric), dim=self.dim)

    def search(self, query: Sequence[float], k: int, metric: str | None = None, where: Any = None, probes: int | None = None, pool: int | None = None) -> DataFrame:
        """Ranking through the snapshot's index where it serves the request, else exact.

        Changes since the snapshot are always scored exactly and hide what they replaced.
        ``pool`` asks for so many candidates at least; one smaller than ``k`` is an error.
        """
        m, check = self._metric(metric), check_k(k)
        if pool is not None and pool < k:
            raise SchemaError(f"a pool of {pool} candidates can't give {k} results")
        q = check_query(query, m, self.dim)
        index = self._open_index()
        if where is not None or index is None or not index.serves(q, check, m):
            return self.exact_search(q, k, m, where)
        _, tail = self.store.sealed_and_tail()
        return indexed_search(index, tail, q, k, m, probes=probes, pool=pool)

    def _open_index(self) -> IvfIndex | None:
        if self._index is None and self.store.snapshot and self.store.files.exists(f"{self._index_folder()}/index.json"):
            self._index = IvfIndex(self.spark, self._index_folder())
        return self._index

    def text_search(self, query: str, k: int, where: Any = None) -> DataFrame:
        """BM25 ranking; statistics come from the records that pass ``where``."""
        return text_top_k(self.frame().drop("vector"), query, k, where=None if where is None else self._where(where))

    def hybrid_search(self, k: int, query_vector: Sequence[float] | None = None, query_text: str | None = None, metric: str | None = None, where: Any = None, window: int = 100, rrf_k: int = RRF_K) -> DataFrame:
        """Fusion of exact vector and text ranking, ``window`` hits of each."""
        check_k(k)
        if query_vector is None and query_text is None:
            raise SchemaError("hybrid search needs a vector, a text or both")
        if window < k:
            raise SchemaError(f"window {window} is smaller than k {k}")
        paths = []
        if query_vector is not None:
            paths.append(self.exact_search(query_vector, window, metric, where))
        if query_text is not None:
            paths.append(self.text_search(query_text, window, where))
        return rrf(paths, k, rrf_k=rrf_k)

    @staticmethod
    def hits(result: DataFrame) -> list[Hit]:
        return [Hit(r["id"], r["score"], r["seq"]) for r in result.collect()]

"""Approximate vector search: inverted lists, pruned by the scan, exactly re-scored."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..errors import SchemaError, StorageError
from ..functions.vector import Metric, check_query
from ..sources.files import Files
from .bounds import checkpoint, spread
from .topk import QUERY_BYTES, batch_matrix, batch_top_k, best_positions, check_k, exact_top_k


@dataclass(frozen=True)
class IvfConfig:
    """Settings of an index. The lists' centres are fitted on at most ``sample`` rows (chosen by
    hash of the id); every row is indexed. ``lists`` None: about the root of the row count. A
    search reads ``probes`` lists at least, and as many as ``held_out`` rows needed as queries for
    ``target_recall`` against the exact ranking of all rows (0: not measured)."""

    lists: int | None = None
    probes: int = 1
    target_recall: float = 0.995
    held_out: int = 400
    sample: int = 50_000
    rounds: int = 8
    seed: int = 0x5EED
    exact_below: int = 100


class VectorIndex(Protocol):
    """What an index offers: candidates of a query, to be re-scored by the caller."""

    name: str

    def __len__(self) -> int: ...

    def candidates(self, query: Sequence[float], k: int) -> DataFrame: ...


class FlatIndex:
    """Every row is a candidate."""

    name = "flat"

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def __len__(self) -> int:
        return self.rows.count()

    def candidates(self, query: Sequence[float], k: int) -> DataFrame:
        return self.rows


#: Rows of one block of distances; with it no matrix has more than about 4 million elements.
BLOCK = 1024
#: From so many centres on they are found through a coarse layer.
FLAT = 1024


class Centres:
    """Centres of lists in two layers, so that neither fitting nor routing compares a row with all.

    Up to ``FLAT`` centres there is one layer. Beyond, each centre belongs to its nearest coarse
    centre; a row looks at the centres of its nearest coarse ones until it has seen ``seen`` times
    as many centres as it needs. Everything is in single precision and in blocks of rows.
    """

    def __init__(self, points: np.ndarray, seen: int = 8, rounds: int = 4, seed: int = 1):
        self.points, self.seen = np.ascontiguousarray(points, dtype=np.float32), seen
        self.squares = (self.points * self.points).sum(1)
        self.coarse = None
        if len(points) > FLAT:
            tops = _lloyd(self.points, round(len(points) ** 0.5), rounds, seed)
            home = _nearest_flat(self.points, tops, (tops * tops).sum(1), 1)[:, 0]
            self.coarse, self.order = tops, np.argsort(home, kind="stable")
            self.ends = np.concatenate(([0], np.cumsum(np.bincount(home, minlength=len(tops)))))

    def __len__(self) -> int:
        return len(self.points)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """Positions of about the ``n`` nearest centres of each row, nearest first."""
        x, n = np.asarray(x, dtype=np.float32), min(n, len(self))
        if self.coarse is None or n * 4 >= len(self):
            return _nearest_flat(x, self.points, self.squares, n)
        sizes = np.diff(self.ends)
        tops = min(len(self.coarse), max(4, self.seen * -(-n * len(self.coarse) // len(self)) + 4))
        out = np.empty((len(x), n), np.int64)
        step = max(16, BLOCK // 4)
        for s in range(0, len(x), step):
            block = x[s : s + step]
            near = _nearest_flat(block, self.coarse, (self.coarse * self.coarse).sum(1), tops)
            best_d, best_i = np.full((len(block), n), np.inf, np.float32), np.zeros((len(block), n), np.int64)
            for top in np.unique(near):
                if not sizes[top]:
                    continue
                rows = np.flatnonzero((near == top).any(1))
                these = self.order[self.ends[top] : self.ends[top + 1]]
                d = self.squares[these] - 2 * (block[rows] @ self.points[these].T)
                both_d, both_i = np.concatenate((best_d[rows], d), 1), np.concatenate((best_i[rows], np.broadcast_to(these, d.shape)), 1)
                part = np.argpartition(both_d, n - 1, axis=1)[:, :n]
                best_d[rows], best_i[rows] = np.take_along_axis(both_d, part, 1), np.take_along_axis(both_i, part, 1)
            short = np.flatnonzero(np.isinf(best_d).any(1))  # its coarse centres hold too few
            out[s : s + step] = np.take_along_axis(best_i, np.argsort(best_d, axis=1, kind="stable"), 1)
            if len(short):
                out[s + short] = _nearest_flat(block[short], self.points, self.squares, n)
        return out


def _nearest_flat(x: np.ndarray, points: np.ndarray, squares: np.ndarray, n: int) -> np.ndarray:
    out, n = np.empty((len(x), min(n, len(points))), np.int64), min(n, len(points))
    step = max(16, min(BLOCK, (BLOCK << 12) // len(points)))
    for s in range(0, len(x), step):
        d = squares - 2 * (x[s : s + step] @ points.T)
        if n == 1:
            out[s : s + step, 0] = d.argmin(1)
            continue
        part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(points) else np.broadcast_to(np.arange(n), d.shape)
        out[s : s + step] = np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1)
    return out


def _lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    centres = x[np.sort(np.random.default_rng(seed).permutation(len(x))[:k])].astype(np.float32)
    for _ in range(rounds):
        near = _nearest_flat(x, centres, (centres * centres).sum(1), 1)[:, 0]
        order = np.argsort(near, kind="stable")
        sizes = np.bincount(near, minlength=len(centres))
        sums = np.add.reduceat(x[order].astype(np.float64), np.concatenate(([0], np.cumsum(sizes)[:-1]))[sizes > 0], axis=0)
        centres[sizes > 0] = sums / sizes[sizes > 0, None]
    return centres


def fit_centres(x: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """K-means over a bounded sample; fewer centres if the sample has fewer different rows. Many
    centres are fitted in two steps: coarse ones, then within each a share by its rows."""
    x = np.unique(np.asarray(x, dtype=np.float32), axis=0)
    lists = min(lists, len(x))
    if lists <= FLAT:
        return _lloyd(x, lists, rounds, seed)
    tops = _lloyd(x, round(lists**0.5), rounds, seed)
    home = _nearest_flat(x, tops, (tops * tops).sum(1), 1)[:, 0]
    order, sizes = np.argsort(home, kind="stable"), np.bincount(home, minlength=len(tops))
    edges = np.round(np.concatenate(([0], np.cumsum(sizes))) * (lists / len(x))).astype(np.int64)
    parts, at = [], 0
    for i, size in enumerate(sizes):
        if edges[i + 1] > edges[i]:
            parts.append(_lloyd(x[order[at : at + size]], int(edges[i + 1] - edges[i]), rounds, seed + i))
        at += size
    return np.concatenate(parts)


class IvfIndex:
    """Index on storage: one Parquet partition per list, so that probing prunes the scan."""

    name = "ivf"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._lists = spark, folder, None
        text = Files(spark).read_text(f"{folder}/index.json")
        if text is None:
            raise StorageError(f"no index in {folder}")
        meta = json.loads(text)
        self.metric, self.dim, self.rows = Metric.of(meta["metric"]), meta["dim"], meta["rows"]
        self.config, self.centres = IvfConfig(**meta["config"]), Centres(np.array(meta["centres"], dtype=np.float32))
        self._schema, self.probes, self.sizes = meta["schema"], meta["probes"], {int(k): v for k, v in meta["sizes"].items()}

    def __len__(self) -> int:
        return self.rows

    @classmethod
    def build(cls, rows: DataFrame, folder: str, metric: Metric | str, dim: int, config: IvfConfig = IvfConfig()) -> "IvfIndex":
        """Indexes rows (id, seq, vector). Dot has no triangle inequality and is refused; vectors
        that are null, of another length, non-finite or (cosine) zero are kept in list -1, which
        every probe reads and exact re-scoring judges."""
        metric, spark = Metric.of(metric), rows.sparkSession
        if metric is Metric.DOT:
            raise SchemaError("an index serves l2 and cosine only")
        n = rows.count()
        lists = config.lists or max(1, min(16_384, round(n**0.5)))
        if lists < 1 or config.probes < 1:
            raise SchemaError("lists and probes must be positive")
        unit, slots = metric is Metric.COSINE, 1 << 40
        share = min(slots, int(slots * min(1.0, 1.05 * config.sample / max(1, n))) + 1)
        drawn = rows.select("id", "vector").where((F.size("vector") == dim) & (F.pmod(F.xxhash64("id"), F.lit(slots)) < share))
        sample = drawn.orderBy(F.xxhash64("id"), "id").limit(config.sample).toArrow()  # about config.sample rows pass the hash
        x, _ = batch_matrix(sample["vector"], dim, np.float32)
        x = x[np.isfinite(x).all(1)]
        if unit:
            x = _units(x[(x != 0).any(1)])
        points = fit_centres(x, lists, config.rounds, config.seed) if len(x) else np.zeros((1, dim), np.float32)
        centres = Centres(points)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v, fits = batch_matrix(b.column("vector"), dim, np.float32)
                ok = np.isfinite(v).all(1) & ((v != 0).any(1) if unit else True)
                v, fits = v[ok], fits[ok]
                lists_of = np.full(b.num_rows, -1, np.int32)
                if len(v):
                    lists_of[fits] = centres.nearest(_units(v) if unit else v, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lists_of)], [*b.schema.names, "list_id"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select("id", "seq", "vector").schema)
        placed = spread(rows.select("id", "seq", "vector")).mapInArrow(assign, f"{schema}, list_id int")
        # A list of very many rows is cut into parts by id, so that no task writes all of it.
        placed.repartition("list_id", F.pmod(F.hash("id"), F.lit(max(1, n // 500_000 // lists)))).write.mode("overwrite").partitionBy("list_id").parquet(f"{folder}/lists")
        schema = f"{schema}, list_id int"
        stored = spark.read.schema(schema).parquet(f"{folder}/lists")
        sizes = {str(r["list_id"]): r["n"] for r in stored.groupBy("list_id").agg(F.count("*").alias("n")).collect()}  # one row a list
        probes = max(config.probes, _probes_needed(stored, centres, metric, dim, n, config)) if config.target_recall else config.probes
        meta = {"metric": metric.name.lower(), "dim": dim, "rows": n, "config": asdict(config), "centres": points.tolist(), "schema": schema, "probes": min(probes, len(centres)), "sizes": sizes}
        Files(spark).replace_text(f"{folder}/index.json", json.dumps(meta))
        return cls(spark, folder)

    def serves(self, query: Sequence[float], k: int, metric: Metric) -> bool:
        """False where only an exact scan will do: other metric, prefix query, k or table size."""
        return metric is self.metric and len(query) == self.dim and k < self.rows > self.config.exact_below

    def lists(self) -> DataFrame:
        """All indexed rows: id, seq, vector, list_id. An index never changes, so its files are listed once."""
        if self._lists is None:
            self._lists = self.spark.read.schema(self._schema).parquet(f"{self.folder}/lists")
        return self._lists

    def probes_for(self, k: int, probes: int | None, pool: int | None) -> int:
        """Lists to read so that about ``pool`` candidates (4 k by default) come together."""
        if pool is not None and pool < k:
            raise SchemaError(f"a pool of {pool} candidates can't give {k} results")
        return max(probes or self.probes, -(-(pool or 4 * k) * len(self.centres) // max(1, self.rows)))

    def candidates(self, query: Sequence[float], k: int, probes: int | None = None, pool: int | None = None) -> DataFrame:
        """Rows of the lists nearest to the query; only their partitions are read."""
        q = np.array(check_query(query, self.metric, self.dim))
        near = [-1, *map(int, self.centres.nearest((_units(q[None]) if self.metric is Metric.COSINE else q[None]), self.probes_for(k, probes, pool))[0])]
        return self.lists().where(F.col("list_id").isin(near)).drop("list_id")

    def batch_search(self, queries: DataFrame, k: int, *, qid_col: str = "qid", qvector_col: str = "qvector", probes: int | None = None, pool: int | None = None, digits: int = 9, query_bytes: int = QUERY_BYTES) -> DataFrame:
        """For each query row its ``k`` best among the rows of its nearest lists: qid, rank, id, score.

        Queries of at most ``query_bytes`` in all go to the tasks as they are: the lists that they
        probe are read once, where they lie. More queries are never collected: each goes to its lists
        by a shuffle and meets them there, long lists and much-asked ones in several parts. Either
        way a list is multiplied with its own queries only, and ``k`` rows per query and part are
        shuffled. Queries that are null, of another length or (cosine) zero give no rows.
        """
        check_k(k)
        n, dim, metric = self.probes_for(k, probes, pool), self.dim, self.metric
        asked = queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(qvector_col).cast("array<float>").alias("qv")).where(F.col("qid").isNotNull() & (F.size("qv") == dim))
        most = max(1, query_bytes // (dim * 8))
        table = asked.limit(most + 1).toArrow()  # at most about query_bytes
        if table.num_rows > most:
            found = self._met(asked.dropDuplicates(["qid"]), k, n, digits)
        else:
            q, fits = _sound(table["qv"], dim, metric)
            ids, first = np.unique(table["qid"].to_numpy()[fits], return_index=True)
            q = q[first]
            near = self.centres.nearest(_units(q) if metric is Metric.COSINE else q, n) if len(q) else np.empty((0, 0), np.int64)
            by_list: dict[int, np.ndarray] = {-1: np.arange(len(q))}
            if near.size:
                order = np.argsort(near, axis=None, kind="stable")
                lists, starts = np.unique(near.ravel()[order], return_index=True)
                by_list |= dict(zip(lists.tolist(), np.split(order // near.shape[1], starts[1:])))
            rows = self.lists().where(F.col("list_id").isin(list(by_list))).select("list_id", F.col("id").cast("long").alias("id"), F.col("vector").alias("v"))
            found = rows.mapInArrow(_list_scorer(ids, q, by_list, k, metric, dim, digits), "qid long, id long, score double")
        w = W.partitionBy("qid").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("qid", "rank", "id", "score")

    def _met(self, asked: DataFrame, k: int, n: int, digits: int, part_rows: int = 50_000) -> DataFrame:
        """Queries joined with their lists on list and part; no group has many more than ``part_rows`` of either."""
        dim, metric, centres = self.dim, self.metric, self.centres

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                q, fits = _sound(b.column("qv"), dim, metric)
                if len(q):
                    near = np.concatenate((np.full((len(q), 1), -1), centres.nearest(_units(q) if metric is Metric.COSINE else q, n)), 1)
                    at = np.repeat(np.arange(len(q)), near.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column("qid").take(pa.array(fits[at])), b.column("qv").take(pa.array(fits[at]))], ["list_id", "qid", "qv"])

        sent = checkpoint(asked.mapInArrow(route, "list_id int, qid long, qv array<float>"))
        asks = {r["list_id"]: r["n"] for r in sent.groupBy("list_id").agg(F.count("*").alias("n")).collect()}  # one row a list
        cut = lambda counts: F.coalesce(F.create_map(*[F.lit(x) for i, c in counts.items() if c > part_rows for x in (int(i), -(-c // part_rows))])[F.col("list_id")], F.lit(1)) if any(c > part_rows for c in counts.values()) else F.lit(1)
        rows_in, asks_in = cut(self.sizes), cut(asks)
        rows = self.lists().where(F.col("list_id").isin(list(asks))).select("list_id", F.col("id").cast("long").alias("id"), F.col("vector").alias("v"))
        rows = rows.withColumn("a", F.pmod(F.xxhash64("id"), rows_in).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), asks_in - 1)))
        sent = sent.withColumn("b", F.pmod(F.xxhash64("qid"), asks_in).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), rows_in - 1)))
        keys = ["list_id", "a", "b"]

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            q, fits = batch_matrix(left["qv"], dim)
            x, kept = _sound(right["v"], dim, metric)
            qids, ids = left["qid"].to_numpy()[fits], right["id"].to_numpy()[kept]
            out = []
            for s in range(0, len(q) if len(x) else 0, 64):
                for i, row in enumerate(_scores(q[s : s + 64], x, metric, digits), s):
                    top = best_positions(ids, row, k)
                    out.append((np.full(len(top), qids[i]), ids[top], row[top]))
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            return pa.table(dict(zip(("qid", "id", "score"), map(pa.array, cols))))

        return sent.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(meet, "qid long, id long, score double")


def _units(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _sound(column: pa.ListArray, dim: int, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """Vectors that can be scored, in double precision, and which rows they are."""
    x, fits = batch_matrix(column, dim)
    ok = np.isfinite(x).all(1) & ((x != 0).any(1) if metric is Metric.COSINE else True)
    return x[ok], fits[ok]


def _scores(q: np.ndarray, x: np.ndarray, metric: Metric, digits: int) -> np.ndarray:
    s, own, lengths = q @ x.T, (q * q).sum(1)[:, None], (x * x).sum(1)
    return np.round(s / np.sqrt(own * lengths) if metric is Metric.COSINE else 2 * s - own - lengths, digits) + 0.0  # no -0


def _probes_needed(stored: DataFrame, centres: Centres, metric: Metric, dim: int, n: int, config: IvfConfig, k: int = 10) -> int:
    """Lists that must be read to find ``target_recall`` of the k nearest of rows held out as queries,
    in the exact ranking of the whole table. The queries are a hash's choice and bounded."""
    slots = 1 << 40
    share = min(slots, int(slots * min(1.0, 1.5 * config.held_out / max(1, n))) + 1)
    drawn = stored.where((F.col("list_id") >= 0) & (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(slots)) < share)).select("id", "vector").orderBy("id").limit(config.held_out)
    table = drawn.toArrow()
    x, fits = batch_matrix(table["vector"], dim)
    if len(x) < 2 or len(centres) == 1:
        return 1
    queries = stored.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid long, qvector array<double>")
    rows = stored.where("list_id >= 0").select(F.struct("id", "list_id").alias("at"), F.xxhash64("id").alias("id"), "vector")
    near = batch_top_k(rows, queries, k + 1, metric, dim=dim)
    homes = rows.select("id", "at.list_id").join(F.broadcast(near.select("qid", "id")), "id").select("qid", "list_id").toArrow()  # held_out * (k + 1) rows
    order = centres.nearest(_units(x) if metric is Metric.COSINE else x, len(centres))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], 1)
    at = np.sort(place[homes["qid"].to_numpy(), homes["list_id"].to_numpy()])
    # A query meets itself in its own list: these places are all 0 and make up 1 / (k + 1).
    own = len(x)
    want = own + int(np.ceil(config.target_recall * (len(at) - own)))
    return int(at[min(len(at), want) - 1]) + 1


def _list_scorer(qids: np.ndarray, q: np.ndarray, by_list: dict[int, np.ndarray], k: int, metric: Metric, dim: int, digits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            x, fits = _sound(b.column("v"), dim, metric)
            ids, lists = (b.column(c).to_numpy(zero_copy_only=False)[fits] for c in ("id", "list_id"))
            order = np.argsort(lists, kind="stable")
            at, starts = np.unique(lists[order], return_index=True)
            for one, mine in zip(at.tolist(), np.split(order, starts[1:]) if len(at) else []):
                asked = by_list[one]
                mine_ids = ids[mine]
                for i, row in zip(asked.tolist(), _scores(q[asked], x[mine], metric, digits)):
                    top = best_positions(mine_ids, row, k)
                    new, old = (mine_ids[top], row[top]), best.get(i)
                    if old is not None:
                        new = (np.concatenate((old[0], new[0])), np.concatenate((old[1], new[1])))
                        top = best_positions(*new, k)
                        new = (new[0][top], new[1][top])
                    best[i] = new
        if best:
            sizes = [len(v[0]) for v in best.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids[list(best)], sizes)), pa.array(np.concatenate([v[0] for v in best.values()])), pa.array(np.concatenate([v[1] for v in best.values()]))], ["qid", "id", "score"])

    return run


def indexed_search(index: IvfIndex, tail: DataFrame, query: Sequence[float], k: int, metric: Metric | str, *, live_op: str = "upsert", probes: int | None = None, pool: int | None = None) -> DataFrame:
    """``k`` best of sealed candidates and the exact tail: id, score, seq.

    ``tail`` holds the latest change per id since the index was built (id, seq, vector, op). Any
    id in it hides its sealed version, whether replaced or deleted. All are scored exactly.
    """
    metric, k = Metric.of(metric), check_k(k)
    q = check_query(query, metric, index.dim)
    if index.serves(q, k, metric):
        sealed = index.candidates(q, k, probes, pool)
    else:
        index.probes_for(k, probes, pool)
        sealed = index.lists().drop("list_id")
    fresh = sealed.join(tail.select("id"), "id", "left_anti")
    every = fresh.unionByName(tail.where(F.col("op") == live_op).select("id", "seq", "vector"))
    return exact_top_k(every, q, k, metric, dim=index.dim)

"""Most similar vectors for every vector, by vantage-point trees in shards.

Vectors are compared by cosine; on unit vectors that is Euclidean distance, which obeys the
triangle inequality. Only pairs of a cosine of at least ``min_cosine`` are wanted, so a search
has a fixed radius r. Two places prune with the inequality, both with ``relax * r`` in place
of r:

* routing: pivots cut the space into cells. A vector lives in the cell of its nearest pivot and
  is asked about in every cell j whose pivot is at most ``2 * relax * r`` farther. Cells are the
  shards, one task each;
* trees: within its shard a query skips the side of a vantage point's median sphere that lies
  more than ``relax * r`` beyond it.

Pivots are records, so the (k + 1)-th nearest pivot bounds how far a vector's k-th neighbour can
be; where that is less than r it takes r's place. A dense ball of vectors is thereby searched at
its own scale and doesn't send every vector to every one of its cells.

Many pivots are looked up through a layer of group pivots: a vector compares itself with those, and
with the pivots of the groups that the inequality (their radius times ``relax``) can't rule out.

``relax`` 1 restores exact search in all of them. Smaller values follow what the distances to a third
point really do: in many dimensions two close vectors differ by a small part of r there. Several
trees per shard make up for what a single one misses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators.bounds import broadcast_if_small, checkpoint, spread
from ..operators.topk import batch_matrix

#: Pivots are drawn from the data; more than this many are never needed on a driver.
MAX_PIVOTS = 65_536

#: Distances below this are taken from differences in double precision: from a cosine in single
#: precision they would be off by as much as they are long.
CLOSE = 0.05

#: From so many pivots on they are looked up through groups.
FLAT_PIVOTS = 1024

#: Pairs that a search holds before it keeps only the best of each row.
MOST_PAIRS = 1 << 22


def similar_pairs(records: DataFrame, *, dim: int, k: int = 10, min_cosine: float | None = 0.9, relax: float = 0.07, trees: int = 5, leaf: int = 128,
                  shard_rows: int = 25_000, seed: int = 17, id_col: str = "external_id", vector_col: str = "vector") -> DataFrame:
    """Unordered pairs (external_id_a < external_id_b), each once, of cosine >= ``min_cosine`` (None:
    of any) in which one is among the ``k`` most similar others of the other. Cosines are taken in
    double precision and rounded to 12 places; equal ones: smaller id first.

    Rows with a null id, or whose vector is null, of another length, all zero or holds null or
    non-finite elements take no part. An id's repeated rows must be copies and count once. Empty
    tables, or tables of one vector, give no pairs. Extra columns are not read.

    Vectors of one direction, up to the rounding of multiples to floats, have cosine 1 with one
    another; in a group of more than k + 1 of them everyone's partners are the smallest ids. So only
    the k + 1 smallest are asked about and the others get the same partners by a join. They can
    still be partners of vectors of other directions, unless they are exact multiples of k + 1
    smaller ids. A group of any size therefore costs a row each, not its square.
    """
    if (min_cosine is not None and not -1 <= min_cosine <= 1) or not 0 <= relax <= 1 or k < 1 or trees < 1 or leaf < 2 or shard_rows < 1:
        raise ValueError("min_cosine lies in [-1, 1], relax in [0, 1]; k, trees and shard_rows are at least 1, leaf 2")
    least = -1.0 if min_cosine is None else min_cosine
    spark = records.sparkSession
    given = records.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))
    rows = checkpoint(spread(given).mapInArrow(_directions(dim), "id long, v array<float>, h long, g long"))
    groups = rows.groupBy("g").agg(F.count("*").alias("n"))
    n, hot = groups.agg(F.count("*"), F.sum((F.col("n") > k + 1).cast("long"))).first()  # different directions
    if not n:
        return spark.createDataFrame([], "external_id_a long, external_id_b long")

    rows, extra = rows.withColumn("ask", F.lit(True)), None
    if hot:
        over = broadcast_if_small(groups.where(F.col("n") > k + 1).select("g"), 32)
        many = rows.join(over, "g", "left_semi")

        def smallest(by: str) -> DataFrame:
            ids = many.select(by, "id").distinct()
            return ids.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy("id"))).where(F.col("r") <= k + 1)

        first = checkpoint(smallest("g"))
        asked = broadcast_if_small(first.select("g", "id"), 64)
        of_exact = broadcast_if_small(checkpoint(smallest("h").select("h", "id")), 64)
        extra = many.select("g", "id").distinct().join(asked, ["g", "id"], "left_anti")
        kept = many.join(of_exact, ["h", "id"], "left_semi").drop("ask").join(asked.withColumn("ask", F.lit(True)), ["g", "id"], "left")
        rows = rows.join(over, "g", "left_anti").unionByName(kept.withColumn("ask", F.coalesce("ask", F.lit(False))))
        lead = first.where(F.col("r") == 1).select("g", F.col("id").alias("a"))

    total = rows.count() if hot else n
    pivots = _pivots(rows, min(MAX_PIVOTS, max(1, round(total / shard_rows))), total, dim, seed)
    if not len(pivots):
        return spark.createDataFrame([], "external_id_a long, external_id_b long")
    if len(pivots) > 1:
        pivots = _more_pivots(rows, pivots, shard_rows, dim, relax, seed)
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    placed = rows.select("id", "v", "ask").mapInArrow(_router(pivots, _labels(spark, len(pivots)), dim, k, radius, relax, seed), "shard int, home boolean, ask boolean, reach float, id long, v array<float>")
    found = placed.repartition(len(pivots), "shard").groupBy("shard").applyInArrow(_searcher(dim, k, least, relax, trees, leaf, seed), "a long, b long, c double")
    best = W.partitionBy("a").orderBy(F.desc("c"), "b")
    near = found.distinct().withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("a", "b", "c")
    if extra is not None:  # the leading id of the direction and its partners, the k best of these
        near = checkpoint(near)
        theirs = near.join(broadcast_if_small(lead, 32), "a").unionByName(lead.select("a", F.col("a").alias("b"), F.lit(1.0).alias("c"), "g"))
        theirs = theirs.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("g", "b")
        near = near.select("a", "b").unionByName(extra.withColumnRenamed("id", "a").join(broadcast_if_small(theirs, 32), "g").select("a", "b"))
    return near.select(F.least("a", "b").alias("external_id_a"), F.greatest("a", "b").alias("external_id_b")).distinct()


def _row_hash(bits: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of unsigned integers."""
    odd = np.random.default_rng(7).integers(1 << 62, size=bits.shape[1], dtype=np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        h = ((bits ^ (bits >> np.uint64(29))) * odd)
        h = ((h ^ (h >> np.uint64(32))) * odd[::-1]).sum(1, dtype=np.uint64)
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def direction_hashes(v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors and their unit vectors: a hash that exact multiples share (the quotients by the
    largest element are rounded from the same numbers), and one shared by vectors in one cell of a
    grid so fine that any two have a cosine of 1 at 12 places."""
    x = v.astype(np.float64)
    exact = x / np.abs(x).max(1, keepdims=True) + 0.0
    cell = np.floor(u * (u.shape[1] ** 0.5 / 0.9e-6)).astype(np.int64)
    return _row_hash(exact.view(np.uint64)), _row_hash(cell.view(np.uint64))


def _directions(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, fits = batch_matrix(b.column("v"), dim, np.float32)
            u, good = _unit(v)
            if not len(u):
                continue
            h, g = direction_hashes(v[good], u)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(u) + 1) * dim, dim, dtype=np.int32)), pa.array(v[good].ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(fits[good])), lists, pa.array(h), pa.array(np.where(h == g, g + 1, g))], ["id", "v", "h", "g"])

    return run


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a direction, as unit vectors in double precision, and which they are."""
    with np.errstate(all="ignore"):
        x = v.astype(np.float64)
        norms = np.sqrt((x * x).sum(1))
        good = np.isfinite(norms) & (norms > 0)
        return x[good] / norms[good, None], np.flatnonzero(good)


def _pivots(rows: DataFrame, wanted: int, n: int, dim: int, seed: int) -> np.ndarray:
    """About ``wanted`` different directions, drawn by a hash of the direction, so dense regions get
    more pivots and multiples of one vector only one."""
    slots = 1 << 40
    share = min(slots, int(slots * min(1.0, (wanted + 4 * wanted**0.5 + 8) / n)) + 1)
    sample = rows.where(F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(slots)) < share).select("h", "v").dropDuplicates(["h"])
    table = sample.orderBy("h").limit(4 * wanted + 64).toArrow()  # bounded by MAX_PIVOTS
    if not table.num_rows:
        table = rows.select("v").limit(1).toArrow()
    x, _ = batch_matrix(table["v"], dim, np.float32)
    u, _ = _unit(x)
    return np.unique(u.astype(np.float32), axis=0)[:wanted] if len(u) <= wanted else u[np.sort(np.random.default_rng(seed).permutation(len(u))[:wanted])].astype(np.float32)


def _homes(rows: DataFrame, pivots: np.ndarray, dim: int, relax: float, seed: int) -> DataFrame:
    """Cell of each row's nearest pivot, with its hash and vector."""
    known = _Pivots(pivots, relax, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, fits = batch_matrix(b.column("v"), dim, np.float32)
            u, good = _unit(v)
            for s in range(0, len(u), 1024):
                row, cell, _ = known.near(u[s : s + 1024], u[s : s + 1024].astype(np.float32), 0.0)
                first = np.flatnonzero(np.diff(row, prepend=-1))
                at = pa.array(fits[good][s : s + 1024])
                yield pa.RecordBatch.from_arrays([pa.array(cell[first].astype(np.int32)), b.column("h").take(at), b.column("v").take(at)], ["cell", "h", "v"])

    return rows.select("h", "v").mapInArrow(run, "cell int, h long, v array<float>")


def _more_pivots(rows: DataFrame, pivots: np.ndarray, shard_rows: int, dim: int, relax: float, seed: int, rounds: int = 3) -> np.ndarray:
    """The pivots, and more of them in cells that turned out to hold over twice ``shard_rows`` rows, as
    many as would bring these to size. Only cell sizes and the new pivots reach the driver."""
    for i in range(rounds):
        placed = _homes(rows, pivots, dim, relax, seed)
        sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * shard_rows).toArrow()
        spare = MAX_PIVOTS - len(pivots)
        if not sizes.num_rows or spare < 1:
            break
        slots = 1 << 40
        # A cell of n rows gets about n / shard_rows of its rows: each with the chance 1 / shard_rows.
        drawn = placed.where(F.col("cell").isin(sizes["cell"].to_pylist()) & (F.pmod(F.xxhash64("h", F.lit(seed + 1 + i)), F.lit(slots)) < slots // shard_rows + 1))
        table = drawn.select("h", "v").dropDuplicates(["h"]).orderBy("h").limit(spare).toArrow()
        x, _ = batch_matrix(table["v"], dim, np.float32)
        more = np.unique(np.concatenate((pivots, _unit(x)[0].astype(np.float32))), axis=0)
        if len(more) == len(pivots):
            break
        pivots = more
    return pivots


def _labels(spark: SparkSession, n: int) -> np.ndarray:
    """Names of the shards, chosen so that Spark's hash puts each into a partition of its own."""
    draws = spark.range(max(64, int(2 * n * np.log(n + 2)) + 8 * n)).select(F.col("id").cast("int").alias("label"))
    first = draws.groupBy(F.pmod(F.hash("label"), F.lit(n)).alias("p")).agg(F.min("label").alias("label")).toArrow()
    labels = first["label"].to_numpy()
    return np.concatenate((labels, -1 - np.arange(n - len(labels)))).astype(np.int32)  # rarely two share a partition


class _Pivots:
    """Pivots with their groups: ``near`` gives those whose distance to a row can matter."""

    def __init__(self, pivots: np.ndarray, relax: float, seed: int):
        self.relax, n = relax, len(pivots)
        if n <= FLAT_PIVOTS:
            self.points, self.order, self.groups = pivots, np.arange(n), None
            return
        some = np.sort(np.random.default_rng(seed).permutation(n)[: round(n**0.5)])
        centres = pivots[some]
        home = np.concatenate([(pivots[s : s + 4096] @ centres.T).argmax(1) for s in range(0, n, 4096)])
        self.order = np.argsort(home, kind="stable")
        self.points, self.groups = pivots[self.order], centres
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(home, minlength=len(centres)))))
        away = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.points, centres[np.sort(home)].astype(np.float64))))
        self.radii = np.array([away[a:b].max(initial=0.0) for a, b in zip(self.ends, self.ends[1:])])

    def near(self, u: np.ndarray, x: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, pivot and distance of all pairs that can matter, by row and distance."""
        if self.groups is None:
            d = _between(u, x, self.points)
            order = np.argsort(d, axis=1, kind="stable")
            return np.repeat(np.arange(len(d)), d.shape[1]), order.ravel(), np.take_along_axis(d, order, 1).ravel()
        d = _between(u, x, self.groups)
        home = d.argmin(1)  # a group's centre is a pivot, so it bounds the nearest pivot's distance
        visit = d - self.relax * self.radii <= (d[np.arange(len(d)), home] + 2 * self.relax * radius + 1e-6)[:, None]
        visit[np.arange(len(d)), home] = True
        rows, pivots, away = [], [], []
        for g in np.flatnonzero(visit.any(0)):
            mine, a, b = np.flatnonzero(visit[:, g]), self.ends[g], self.ends[g + 1]
            rows.append(np.repeat(mine, b - a))
            pivots.append(np.tile(self.order[a:b], len(mine)))
            away.append(_between(u[mine], x[mine], self.points[a:b]).ravel())
        row, pivot, away = np.concatenate(rows), np.concatenate(pivots), np.concatenate(away)
        order = np.lexsort((pivot, away, row))
        return row[order], pivot[order], away[order]


def _between(u: np.ndarray, x: np.ndarray, points: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum(0, 2 - 2 * (x @ points.T))).astype(np.float64)
    i, j = np.nonzero(d < CLOSE)
    d[i, j] = _distances(u, points, i, j)
    return d


def _router(pivots: np.ndarray, labels: np.ndarray, dim: int, k: int, radius: float, relax: float, seed: int):
    known = _Pivots(pivots, relax, seed)
    step = max(16, (1 << 22) // max(len(pivots) if known.groups is None else FLAT_PIVOTS, 1))  # bounded matrices, however many pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v, fits = batch_matrix(b.column("v"), dim, np.float32)
            u, good = _unit(v)
            if not len(u):
                continue
            ids, ask = (b.column(c).to_numpy(zero_copy_only=False)[fits][good] for c in ("id", "ask"))
            v = v[good]
            x = u.astype(np.float32)
            for s in range(0, len(u), step):
                row, cell, d = known.near(u[s : s + step], x[s : s + step], radius)
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                sizes = np.diff(np.append(starts, len(row)))
                reach = np.full(len(starts), radius)
                enough = sizes > k
                bound = d[starts[enough] + k]
                reach[enough] = np.minimum(reach[enough], bound + np.where(bound < CLOSE, 2e-6, 1e-3))  # rounding, also of the cosines that are compared
                home = np.arange(len(row)) == np.repeat(starts, sizes)
                asks = ask[s : s + step]
                keep = home | (np.repeat(asks, sizes) & (d <= np.repeat(d[starts] + 2 * relax * reach, sizes)))
                row, cell, home = row[keep], cell[keep], home[keep]
                out = v[s : s + step][row]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(row) + 1) * dim, dim, dtype=np.int32)), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(labels[cell]), pa.array(home), pa.array(asks[row]), pa.array(reach[row].astype(np.float32)), pa.array(ids[s : s + step][row]), lists], ["shard", "home", "ask", "reach", "id", "v"])

    return run


def _searcher(dim: int, k: int, min_cosine: float, relax: float, trees: int, leaf: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        v, _ = batch_matrix(table["v"], dim, np.float32)
        ids, first = np.unique(table["id"].to_numpy(), return_index=True)
        home, ask, reach = (table[c].to_numpy()[first] for c in ("home", "ask", "reach"))
        u, _ = _unit(v[first])
        a, b, c = search(u, ids, np.flatnonzero(home), reach, k, min_cosine, relax, trees, leaf, seed, np.flatnonzero(ask))
        return pa.table({"a": pa.array(a), "b": pa.array(b), "c": pa.array(c)})

    return run


def search(u: np.ndarray, ids: np.ndarray, members: np.ndarray, reach: np.ndarray, k: int, min_cosine: float, relax: float, trees: int, leaf: int, seed: int, asking: np.ndarray | None = None):
    """The rows ``asking`` of ``u`` (default: all) as queries against the rows ``members``: ids a and b
    and their cosine, at most the k best b of each a. ``reach`` bounds how far the wanted neighbours
    of a row are. ``ids``, ``members`` and ``asking`` ascend."""
    asking = np.arange(len(u)) if asking is None else asking
    x = np.ascontiguousarray(u, dtype=np.float32)
    rng = np.random.default_rng(seed)
    slack = (np.asarray(reach) * min(relax, 1.0)).astype(np.float32)
    key, held = [np.empty(0, np.int64)], 0
    for _ in range(1 if relax >= 1 or len(members) <= leaf else trees):
        for q, m in _one_tree(u, x, members, asking, slack, k, min_cosine, leaf, rng):
            key.append(np.minimum(q, m).astype(np.int64) * len(x) + np.maximum(q, m))
            held += len(q)
            if held > MOST_PAIRS:
                key = [np.unique(np.concatenate(key))]
                if len(key[0]) > MOST_PAIRS // 2:
                    q, m, _ = _best(u, key[0], k, min_cosine)
                    key = [np.unique(np.minimum(q, m) * len(x) + np.maximum(q, m))]
                held = max(0, len(key[0]) - len(x) * k)  # what can't be less doesn't count
    q, m, c = _best(u, np.unique(np.concatenate(key)), k, min_cosine)
    asked = np.zeros(len(u), bool)
    asked[asking] = True
    q, m, c = q[asked[q]], m[asked[q]], c[asked[q]]  # the others have met only some of their neighbours
    return ids[q], ids[m], c


def _best(u: np.ndarray, key: np.ndarray, k: int, min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of different pairs, coded as smaller * len(u) + larger place, the k best of every place in
    double precision, equal cosines by place."""
    q, m = key // len(u), key % len(u)
    c = np.empty(len(q))
    for s in range(0, len(q), 1 << 16):
        c[s : s + (1 << 16)] = np.round(np.einsum("ij,ij->i", u[q[s : s + (1 << 16)]], u[m[s : s + (1 << 16)]]), 12)
    keep = (c >= min_cosine) & (q != m)
    q, m, c = q[keep], m[keep], c[keep]
    q, m, c = np.concatenate((q, m)), np.concatenate((m, q)), np.concatenate((c, c))
    order = np.lexsort((m, -c, q))
    q, m, c = q[order], m[order], c[order]
    starts = np.flatnonzero(np.diff(q, prepend=-1))
    top = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) < k
    return q[top], m[top], c[top]


def _distances(u: np.ndarray, points: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances between the rows i of ``u`` and j of ``points``, by differences in double precision."""
    out = np.empty(len(i))
    for s in range(0, len(i), 1 << 14):
        d = u[i[s : s + (1 << 14)]] - points[j[s : s + (1 << 14)]]
        out[s : s + (1 << 14)] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _to_vantage(u: np.ndarray, x: np.ndarray, rows: np.ndarray, vantage: int) -> np.ndarray:
    d = np.sqrt(np.maximum(0, 2 - 2 * (x[rows] @ x[vantage]))).astype(np.float64)
    near = np.flatnonzero(d < CLOSE)
    d[near] = _distances(u, u[vantage][None], rows[near], np.zeros(len(near), np.int64))
    return d


def _one_tree(u: np.ndarray, x: np.ndarray, members: np.ndarray, asking: np.ndarray, slack: np.ndarray, k: int, min_cosine: float, leaf: int, rng) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Builds one tree over ``members``, sends the asking rows down it together and yields pairs."""
    stack = [(members, asking)]
    while stack:
        m, q = stack.pop()
        if not len(m) or not len(q):
            continue
        if len(m) > leaf:
            vantage = m[rng.integers(len(m))]
            dm, dq = (_to_vantage(u, x, i, vantage) for i in (m, q))
            mid = np.partition(dm, len(dm) // 2)[len(dm) // 2]
            inner = dm < mid
            if inner.any():  # else half of them lie at one distance: no sphere can divide them
                stack.append((m[inner], q[dq - slack[q] < mid]))
                stack.append((m[~inner], q[dq + slack[q] >= mid]))
                continue
        for s in range(0, len(m), 2048):
            for t in range(0, len(q), 1024):
                i, j = _close(u, x, q[t : t + 1024], m[s : s + 2048], k, min_cosine)
                yield q[t + i], m[s + j]


def _close(u: np.ndarray, x: np.ndarray, q: np.ndarray, m: np.ndarray, k: int, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Where the cosines reach the minimum. Of rows with very many such places those that rounding
    may have put below the k-th best; if these are many too, the best in double precision, equal
    ones by place. One more than k, as a row may meet itself."""
    s = x[q] @ x[m].T
    margin = (x.shape[1] + 4) * 2.0**-24  # bounds the error of a cosine of rounded unit vectors
    near = s >= np.float32(min_cosine - max(1e-5, margin))
    many = np.flatnonzero(near.sum(1) > 4 * k + 1)
    if len(many):
        edge = np.partition(s[many], len(m) - k - 1, axis=1)[:, len(m) - k - 1]
        near[many] &= s[many] >= (edge - np.float32(2 * margin))[:, None]
        many = many[near[many].sum(1) > 4 * k + 1]
    if len(many):
        c = np.round(u[q[many]] @ u[m].T, 12)
        edge = np.partition(c, len(m) - k - 1, axis=1)[:, len(m) - k - 1, None]
        above, level = c > edge, c == edge
        near[many] = above | level & (np.cumsum(level, axis=1) <= k + 1 - above.sum(1)[:, None])
    return np.nonzero(near)

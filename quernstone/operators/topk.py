"""Exact vector ranking: one query, filtered, and many queries at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..errors import SchemaError
from ..functions.vector import Metric, check_query, score
from .bounds import checkpoint

#: Bytes of query vectors that one task holds at once; more queries run in several passes.
QUERY_BYTES = 64 << 20


def check_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise SchemaError(f"k must be a non-negative integer, not {k!r}")
    return k


def exact_top_k(df: DataFrame, query: Sequence[float], k: int, metric: Metric | str = "l2", *, where: Column | None = None,
                id_col: str = "id", vector_col: str = "vector", seq_col: str | None = "seq", dim: int | None = None,
                precision: str = "double", digits: int | None = None) -> DataFrame:
    """The ``k`` rows of highest score: columns id, score[, seq]. Equal scores: smaller id first.

    ``where`` restricts the rows before ranking. Rows without a score (null or short vector; zero
    vector under cosine) or with a NaN score are left out. ``k`` 0 gives no row, a ``k`` beyond
    the table gives all. An empty table gives an empty result. Repeated rows each count.
    ``digits`` rounds scores before ranking. Only the named columns are read.
    """
    metric, check = Metric.of(metric), check_k(k)
    q = check_query(query, metric, dim)
    if where is not None:
        df = df.where(where)
    s = score(F.col(vector_col), q, metric, precision)
    if digits is not None:
        s = F.round(s, digits)
    keep = [F.col(id_col)] + [F.col(seq_col)] * (seq_col is not None)
    scored = df.select(*keep, s.alias("score")).where(F.col("score").isNotNull() & ~F.isnan("score"))
    out = [id_col, "score"] + [seq_col] * (seq_col is not None)
    return scored.select(*out).orderBy(F.desc("score"), id_col).limit(check)


def best_positions(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by score descending, id ascending."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))][:k]
    return np.lexsort((ids, -scores))[:k]


def batch_matrix(column: pa.ListArray, dims: int, dtype=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an Arrow list column that have exactly ``dims`` elements and no null, and which."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    bad = np.zeros(0, bool)
    if flat.null_count:
        bad = flat.is_null().to_numpy(zero_copy_only=False)
        flat = flat.fill_null(0)
    values, starts = flat.to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(np.maximum(lengths, 0))))[:-1]
    fits = np.flatnonzero(lengths == dims)
    if len(bad):
        holes = np.concatenate(([0], np.cumsum(bad)))
        fits = fits[holes[starts[fits] + dims] == holes[starts[fits]]]
    if len(fits) == len(lengths) and len(values) == len(fits) * dims:
        return values.reshape(-1, dims).astype(dtype, copy=False), fits
    return values[starts[fits][:, None] + np.arange(dims)].astype(dtype, copy=False), fits


def batch_top_k(df: DataFrame, queries: DataFrame, k: int, metric: Metric | str = "l2", *, dim: int, id_col: str = "id",
                vector_col: str = "vector", qid_col: str = "qid", qvector_col: str = "qvector", digits: int = 9,
                query_bytes: int = QUERY_BYTES) -> DataFrame:
    """For each query row the ``k`` best rows of ``df``: columns qid, rank (from 1), id, score.

    One pass over ``df`` serves all queries: each task multiplies its rows with the block of
    queries and keeps ``k`` per query, so only ``k`` rows per task and query are shuffled. When
    the queries exceed ``query_bytes``, they are cut into blocks by hash and ``df`` is read once
    per block; a block's result is written to the checkpoint folder before the next block is taken,
    so the driver never holds more than one. Scores are rounded to ``digits`` before ranking; equal scores: smaller id first.
    Ids of both sides must be integers. Vectors that are null, of another length than ``dim`` or
    hold nulls or non-finite elements take no part, nor do zero vectors under cosine; such
    queries give no rows, and a repeated query id counts once. Empty input gives an empty result.
    """
    metric, _ = Metric.of(metric), check_k(k)
    clean = queries.select(F.col(qid_col).cast("long").alias("qid"), F.col(qvector_col).alias("qv")).where(F.size("qv") == dim).where("qid is not null").dropDuplicates(["qid"])
    n = clean.count()
    blocks = max(1, -(-n * dim * 8 // query_bytes))
    schema = "qid long, id long, score double"
    parts = []
    for b in range(blocks):
        rows = clean.where(F.pmod(F.hash("qid"), F.lit(blocks)) == b).toArrow()  # at most about query_bytes
        q, fits = batch_matrix(rows["qv"], dim)
        good = np.isfinite(q).all(1) & ((q != 0).any(1) if metric is Metric.COSINE else True)
        block = (rows["qid"].to_numpy()[fits][good].astype(np.int64), q[good])
        part = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.size("v") == dim).where("id is not null").mapInArrow(_scorer(block, k, metric, dim, digits), schema)
        parts.append(checkpoint(part) if blocks > 1 else part)
    found = reduce(DataFrame.unionByName, parts)
    w = W.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def _scorer(block: tuple[np.ndarray, np.ndarray], k: int, metric: Metric, dim: int, digits: int):
    qids, q = block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = np.sqrt((q * q).sum(1))
        ids_of, scores_of = [np.empty(0, np.int64)] * len(qids), [np.empty(0)] * len(qids)
        for batch in batches:
            x, fits = batch_matrix(batch.column("v"), dim)
            ok = np.isfinite(x).all(1) & ((x != 0).any(1) if metric is Metric.COSINE else True)
            x, ids = x[ok], batch.column("id").to_numpy(zero_copy_only=False)[fits][ok]
            if not len(ids) or not len(qids) or not k:
                continue
            for a in range(0, len(qids), 256):
                s = q[a : a + 256] @ x.T
                if metric is Metric.COSINE:
                    s /= norms[a : a + 256, None] * np.sqrt((x * x).sum(1))
                elif metric is Metric.L2:
                    s = 2 * s - norms[a : a + 256, None] ** 2 - (x * x).sum(1)
                s = np.round(s, digits) + 0.0  # no -0
                for i, row in enumerate(s, a):
                    best = best_positions(ids, row, k)
                    all_ids, all_scores = np.concatenate((ids_of[i], ids[best])), np.concatenate((scores_of[i], row[best]))
                    best = best_positions(all_ids, all_scores, k)
                    ids_of[i], scores_of[i] = all_ids[best], all_scores[best]
        if len(qids):
            sizes = [len(x) for x in ids_of]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, sizes)), pa.array(np.concatenate(ids_of)), pa.array(np.concatenate(scores_of))], ["qid", "id", "score"])

    return run


def recall_at_k(found: DataFrame, truth: DataFrame, k: int, *, qid: str = "qid", id_col: str = "id", threshold: float = 0.002) -> DataFrame:
    """One row: queries, k, mean_recall, min_recall, passed (mean >= 1 - threshold).

    Recall of a query is |found ∩ truth| / min(k, |truth|), the divisor at least 1. Both sides
    are cut to distinct ids by the caller's ranking beforehand. A query that is only in ``truth``
    counts with recall 0, one without truth is not a query. No queries: recall 1.
    """
    check_k(k)
    t = truth.select(F.col(qid).alias("q"), F.col(id_col).alias("i")).distinct()
    f = found.select(F.col(qid).alias("q"), F.col(id_col).alias("i"), F.lit(1).alias("hit")).distinct()
    per = t.join(f, ["q", "i"], "left").groupBy("q").agg(F.count("hit").alias("hits"), F.count("*").alias("n"))
    recall = F.col("hits") / F.greatest(F.least(F.lit(k), F.col("n")), F.lit(1))
    one = per.agg(F.count("*").alias("queries"), F.coalesce(F.avg(recall), F.lit(1.0)).alias("mean_recall"), F.coalesce(F.min(recall), F.lit(1.0)).alias("min_recall"))
    return one.select("queries", F.lit(k).cast("long").alias("k"), "mean_recall", "min_recall", (F.col("mean_recall") >= 1 - threshold).alias("passed"))

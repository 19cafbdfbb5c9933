"""Reciprocal rank fusion of ranked results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..errors import SchemaError
from .topk import check_k

# Fixed value: rank offset of the fusion.
RRF_K = 60


#: Hits of a path that ``rrf`` ranks in one task.
WINDOW = 10_000


def rrf(paths: Sequence[DataFrame], k: int, *, rrf_k: int = RRF_K, id_col: str = "id", digits: int = 12, window: int = WINDOW) -> DataFrame:
    """Fuses results (id, score[, seq]) to the ``k`` best: id, score[, seq].

    Each path is ranked by score descending, id ascending, and adds 1/(rrf_k + rank) to its ids;
    only ranks count, never the scores. ``seq`` comes from the first path that holds the id. Equal
    sums (after rounding to ``digits``): smaller id first. A path is the result of a search and is
    ranked in one task; one of more than ``window`` hits is an error, as whole tables of hits are
    what ``rrf_by_key`` is for. A path may be empty; rows with a null id or score don't count; ``k`` 0
    gives no row.
    """
    if not paths:
        raise SchemaError("fusion needs at least one path")
    check_k(k)
    with_seq = all("seq" in p.columns for p in paths)
    ranked = []
    for n, p in enumerate(paths):
        p = p.where(F.col(id_col).isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
        rank = F.row_number().over(W.orderBy(F.desc("score"), id_col))
        p = p.orderBy(F.desc("score"), id_col).limit(window + 1)  # each task passes on no more
        place = F.when(rank > window, F.raise_error(F.lit(f"a path has more than {window} hits; use rrf_by_key"))).otherwise(rank)
        ranked.append(p.select(id_col, (F.lit(1.0) / (F.lit(rrf_k) + place)).alias("part"), F.lit(n).alias("path"), *["seq"] * with_seq))
    all_paths = reduce(DataFrame.unionByName, ranked)
    parts = F.aggregate(F.array_sort(F.collect_list(F.struct("path", "part"))), F.lit(0.0), lambda acc, x: acc + x["part"])
    fused = all_paths.groupBy(id_col).agg(F.round(parts, digits).alias("score"), *[F.min_by("seq", "path").alias("seq")] * with_seq)
    return fused.orderBy(F.desc("score"), id_col).limit(k)


def rrf_by_key(hits: DataFrame, k: int, *, key: str = "query_id", path: str = "path", id_col: str = "external_id", score: str = "score", rrf_k: int = RRF_K, digits: int = 9) -> DataFrame:
    """The same fusion for many queries at once: key, id, score, rank of the ``k`` best per key.

    ``hits`` holds one row per key, path and id; of repeated ones the highest score counts. Rows with
    a null in these columns or a NaN score don't count. Hits are ranked within key and path by a
    window, so a (key, path) group is what one task must sort (it spills if it must). Equal sums,
    after rounding to ``digits``: smaller id first. ``k`` 0 gives no row.
    """
    check_k(k)
    given = hits.select(F.col(key).alias("_k"), F.col(path).alias("_p"), F.col(id_col).alias("_i"), F.col(score).cast("double").alias("_s")).na.drop().where(~F.isnan("_s"))
    best = given.groupBy("_k", "_p", "_i").agg(F.max("_s").alias("_s"))
    place = F.row_number().over(W.partitionBy("_k", "_p").orderBy(F.desc("_s"), "_i"))
    fused = best.withColumn("_part", F.lit(1.0) / (F.lit(rrf_k) + place)).groupBy("_k", "_i").agg(F.round(F.sum("_part"), digits).alias("_sum"))
    rank = F.row_number().over(W.partitionBy("_k").orderBy(F.desc("_sum"), "_i"))
    return fused.withColumn("_r", rank.cast("long")).where(F.col("_r") <= k).select(F.col("_k").alias(key), F.col("_i").alias(id_col), F.col("_sum").alias("score"), F.col("_r").alias("rank"))

"""One ranking from several differently scaled scores: closeness to an ideal point.

Per query each path is a criterion. Its values are brought to one scale, the best value of each
criterion makes the ideal point and the worst the anti-ideal; an item's place follows from its
weighted distances to both: closeness = to_anti / (to_anti + to_ideal).

``scale="winsor"`` clips a path's scores to two quantiles, taken by exact place, and divides by their vector norm, so
neither an outlier nor a large range lets a path dominate. ``scale="reciprocal_rank"`` replaces
scores by 1 / (60 + place), which removes scale altogether; with city-block distance the
distance to the anti-ideal (0 on every path) is then the sum of those parts and closeness is
that sum over a constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.bounds import broadcast_if_small, checkpoint
from ..operators.fusion import RRF_K

#: A (query, path) group of more hits than this is ranked by a distributed sort.
WINDOW_ROWS = 100_000


def clean_hits(hits: DataFrame) -> DataFrame:
    """query_id, path, external_id, score: nulls and NaN left out, the best of repeated hits kept."""
    given = hits.select("query_id", "path", "external_id", F.col("score").cast("double").alias("score")).na.drop().where(~F.isnan("score"))
    return given.groupBy("query_id", "path", "external_id").agg(F.max("score").alias("score"))


def places(hits: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``hits`` with ``place`` 1, 2, ... per query and path by score descending, then external_id.

    Groups of ordinary size are ranked by a window. Larger ones are sorted over many tasks by
    range; the place is the position in the task plus the counts of the tasks before.
    """
    keys = ["query_id", "path"]
    order = [F.desc("score"), F.asc("external_id")]
    ranked = F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")
    big = hits.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > window_rows).select(*keys)
    if big.isEmpty():
        return hits.withColumn("place", ranked)
    big = broadcast_if_small(big, 64)
    usual = hits.join(big, keys, "left_anti").withColumn("place", ranked)
    many = hits.join(big, keys, "left_semi").repartitionByRange(*keys, *order)
    many = checkpoint(many.withColumn("_p", F.spark_partition_id()))  # the ranges must not be drawn anew
    before = many.groupBy(*keys, "_p").agg(F.count("*").alias("n"))
    before = before.withColumn("_before", F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = many.withColumn("_r", F.row_number().over(W.partitionBy(*keys, "_p").orderBy(*order)))
    placed = local.join(broadcast_if_small(before, 64), [*keys, "_p"]).withColumn("place", F.col("_before") + F.col("_r"))
    return usual.unionByName(placed.select(*usual.columns))


def ideal_point(hits: DataFrame, *, scale: str = "winsor", power: int = 2, low: float = 0.05, high: float = 0.95, weights: dict[str, float] | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """query_id, external_id, to_anti, to_ideal, closeness of each item a query has on some path.

    A path that lacks the item counts as its anti-ideal value there. ``weights`` by path, 1 by
    default. Equal points have equal closeness; a query whose items all coincide has closeness 0.
    Hits with a null in any column or a NaN score don't count, of repeated hits the highest
    score does; an infinite score is clipped like any outlier (or placed first or last). An
    empty table gives no rows. Extra columns are not read.
    """
    if scale not in ("winsor", "reciprocal_rank") or power not in (1, 2) or not 0 <= low < high <= 1:
        raise ValueError("scale is winsor or reciprocal_rank, power 1 or 2, and 0 <= low < high <= 1")
    rows, path = clean_hits(hits), ["query_id", "path"]
    if scale == "reciprocal_rank":
        valued = places(rows).withColumn("value", F.lit(1.0) / (F.lit(rrf_k) + F.col("place")))
        marks = valued.groupBy(*path).agg(F.lit(0.0).alias("anti"), F.lit(1.0 / (rrf_k + 1)).alias("ideal"))
    else:
        sizes = rows.groupBy(*path).agg(F.count("*").alias("n"))
        at = lambda q: F.max(F.when(F.col("place") == F.least(F.col("n"), F.floor(F.col("n") - F.col("n") * F.lit(float(q))) + 1), F.col("score")))
        edges = places(rows).join(sizes, path).groupBy(*path).agg(F.array(at(low), at(high)).alias("e"))
        clipped = rows.join(edges, path).withColumn("clip", F.greatest(F.least(F.col("score"), F.col("e")[1]), F.col("e")[0]))
        norms = clipped.groupBy(*path).agg(F.sqrt(F.sum(F.col("clip") * F.col("clip"))).alias("norm"), F.min("clip").alias("lo"), F.max("clip").alias("hi"))
        length = F.when((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.col("norm")).otherwise(1.0)
        marks = norms.select(*path, length.alias("length"), (F.col("lo") / length).alias("anti"), (F.col("hi") / length).alias("ideal"))
        valued = clipped.join(marks.select(*path, "length"), path).withColumn("value", F.col("clip") / F.col("length"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in (weights or {"": 1.0}).items() for x in kv])[F.col("path")], F.lit(1.0)).cast("double")

    def part(x):
        return F.pow(weight * x, power) if power == 2 else weight * F.abs(x)

    # A query's full distance to the ideal if an item had no path at all, one row per query; what
    # an item has on a path moves it from there.
    whole = marks.groupBy("query_id").agg(F.sum(part(F.col("ideal") - F.col("anti"))).alias("_all"))
    moved = valued.join(marks.select(*path, "anti", "ideal"), path).groupBy("query_id", "external_id").agg(
        F.sum(part(F.col("value") - F.col("anti"))).alias("_up"),
        F.sum(part(F.col("ideal") - F.col("anti")) - part(F.col("ideal") - F.col("value"))).alias("_nearer"))
    root = (lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))) if power == 2 else (lambda c: F.greatest(c, F.lit(0.0)))
    left = F.when(F.col("_all") - F.col("_nearer") > F.col("_all") * 1e-12, F.col("_all") - F.col("_nearer")).otherwise(0.0)  # not the rounding of two equal sums
    both = moved.join(whole, "query_id").select("query_id", "external_id", root(F.col("_up")).alias("to_anti"), root(left).alias("to_ideal"))
    reach = F.col("to_anti") + F.col("to_ideal")
    return both.withColumn("closeness", F.when(reach > 0, F.col("to_anti") / reach).otherwise(0.0))


def best_items(ranked: DataFrame, k: int = 10, by: str = "closeness", digits: int = 9) -> DataFrame:
    """The ``k`` best items per query by ``by``, rounded; equal values: smaller external_id first."""
    value = F.round(F.col(by), digits)
    order = W.partitionBy("query_id").orderBy(F.desc(value), "external_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

"""Current state of keyed, versioned rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .bounds import broadcast_if_small


def latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of highest ``seq`` per key, all columns kept; rows with a null key or seq are left out.

    An aggregate with map-side combine, so a key that holds a third of all rows reaches the
    reducer as one row per task. Rows that tie in seq must be copies; one of them is kept.
    """
    rest = [c for c in df.columns if c != key]
    best = df.where(F.col(key).isNotNull() & F.col(seq).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def live_view(df: DataFrame, key: str, seq: str, is_live: Column) -> DataFrame:
    """The latest row per key where that row is live; a tombstone that is newest hides its key.

    ``is_live`` may use any column; a null verdict counts as not live. Empty input: empty result.
    """
    verdict = df.withColumn("_live", F.coalesce(is_live, F.lit(False)))
    return latest(verdict, key, seq).where("_live").drop("_live")


def point_get(live: DataFrame, key: str, value) -> DataFrame:
    """The live row of one key, by a filter that reaches the scan."""
    return live.where(F.col(key) == F.lit(value))


def batch_get(live: DataFrame, key: str, values: Sequence) -> DataFrame:
    """One row per requested key in the order asked, ``pos`` first; all null where there is none.

    A key asked for twice comes twice. An empty request gives an empty result. The request is
    the caller's list and is sent to all tasks only if it is small.
    """
    spark, kind = live.sparkSession, live.schema[key].dataType
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"pos long, _asked {kind.simpleString()}")
    rest = [c for c in live.columns if c != key]
    small = broadcast_if_small(asked, 64)
    hit = live.join(small.select("_asked").distinct(), live[key] == F.col("_asked"), "left_semi")
    return asked.join(hit, asked["_asked"] == hit[key], "left").select("pos", F.col("_asked").alias(key), *rest).orderBy("pos")


def unknown_keys(wanted: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Keys of ``wanted`` that aren't live: what a delete must refuse."""
    return wanted.select(key).distinct().join(live.select(key), key, "left_anti")


def shadowed(sealed: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """Rows of ``sealed`` whose key has no newer change."""
    return sealed.join(newer.select(key).distinct(), key, "left_anti")

"""Summaries of measured times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def timing_summary(samples: DataFrame, value: Column | str, *by: str) -> DataFrame:
    """n, mean, p50, p95 and p99 of a number per group; percentiles interpolate between neighbours.

    Null and NaN samples don't count. Without ``by`` it is one row, all null but n = 0 for no samples.
    Percentiles are exact: equal values are counted before the shuffle, not sent one by one.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = samples.select(*by, x.alias("_x")).where("_x is not null and not isnan(_x)").groupBy(*by, "_x").agg(F.count("*").alias("_n"))
    return rows.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), (F.sum(F.col("_x") * F.col("_n")) / F.sum("_n")).alias("mean"),
                                 *[F.percentile("_x", F.lit(q / 100), F.col("_n")).alias(f"p{q}") for q in (50, 95, 99)])

"""Size-checked broadcasts and checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side is broadcast only up to so many rows; callers say how wide a row is at most.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if a count proves that it fits ``limit``, else as it is.

    The count stops after one row more than fits, so it never scans for longer than needed.
    """
    most = max(1, limit // row_bytes)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def scratch_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder that all executors reach: under ``spark.checkpoint.dir``, or, in a local
    session that has none, under a temporary one that is removed when Python ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    return f"{base.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


_BASES: list[str] = []


def _local_base() -> str:
    if not _BASES:
        _BASES.append(tempfile.mkdtemp(prefix="scratch-"))
        atexit.register(shutil.rmtree, _BASES[0], ignore_errors=True)
    return _BASES[0]


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage cut.

    The folder is ``spark.checkpoint.dir`` (on a cluster: shared storage). Where the session has
    none, as in tests, a temporary one is set.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(scratch_folder(df.sparkSession, "checkpoint"))
    return df.checkpoint()


#: Inputs up to this size may be dealt out to idle cores.
SPREAD_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if it is a small scan that would keep most of them idle.

    A file of one row group is one task, however much work its rows cause. Only plain scans
    (projections and filters of stored files) with at most half as many partitions as there are
    cores, and of at most a gigabyte, are touched: at scale nothing is shuffled.
    """
    query = df._jdf.queryExecution()
    node = query.optimizedPlan()
    if int(str(node.stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().head()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not node.nodeName().startswith("Relation") and node.nodeName() != "LogicalRelation" or query.toRdd().getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores)

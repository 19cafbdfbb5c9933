"""Structured Streaming over change feeds (beyond the reference's own surface)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..schema import UPSERT
from ..sources.store import Store


def stream_into(store: Store, changes: DataFrame, checkpoint_dir: str, available_now: bool = True) -> StreamingQuery:
    """Applies a stream of changes to a store, one commit per micro-batch.

    ``changes`` has the store's columns and ``op`` (upsert or delete), ordered by ``ord`` within a
    batch. The last change of an id in a batch stands. A batch that the engine replays after a
    failure repeats the same last-wins result, so the state stays right.
    """
    from pyspark.sql import functions as F

    from ..operators.liveview import latest

    cols = ["id", "vector", "norm", "text", *store.settings.meta_columns()]

    def apply(batch: DataFrame, _: int) -> None:
        last = latest(batch, "id", "ord")
        try:
            store.stage(last.where(F.col("op") == UPSERT).select(*cols), UPSERT)
            gone = last.where(F.col("op") != UPSERT).select("id").join(store.live().select("id"), "id", "left_semi")
            store.delete(gone)
            store.commit()
        except Exception:
            store.rollback()
            raise

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

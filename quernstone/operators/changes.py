"""Applying a feed of inserts, updates and deletes by equality deletes with sequence numbers.

A change is split in two: what it adds (an insert row with its sequence number) and what it
removes (a delete key: everything of this key with a smaller number). A tombstone is a delete
key only; an update is both. Readers keep the insert rows for which no later delete key exists.
Neither side looks at the other while being written, so order of arrival, repeats and late
changes don't matter.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import SchemaError, StorageError
from ..sources.files import Files


def delete_keys(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Per key the number of its last delete: rows of the key with a smaller number are gone.

    Compacted with map-side combine, as a later delete covers all earlier ones.
    """
    return changes.groupBy(key).agg(F.max(seq).alias("_deleted_below"))


def insert_rows(changes: DataFrame, key: str, seq: str, payload: Sequence[str] = ()) -> DataFrame:
    """Per key its newest insert row. An older one is covered by the newest one's own delete key,
    so it is dropped before the shuffle: a key with a third of all changes costs one row a task."""
    if not payload:
        return changes.groupBy(key).agg(F.max(seq).alias(seq))
    best = changes.groupBy(key).agg(F.max_by(F.struct(seq, *payload), F.col(seq)).alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in (seq, *payload)])


def current_state(changes: DataFrame, key: str, seq: str, *, is_insert: Column, is_delete: Column, payload: Sequence[str] = ()) -> DataFrame:
    """Live state after all changes: key, seq and the payload columns of each live key.

    ``is_insert`` and ``is_delete`` say what a change row is; a row that is neither (or null in
    both) is ignored. Copies of a change count once. A delete with the number of an insert
    leaves the insert (it removes smaller numbers only). Rows whose key or seq is null are
    ignored. An empty feed gives an empty state. Both sides are shuffled once, by key.
    """
    given = changes.where(F.col(key).isNotNull() & F.col(seq).isNotNull())
    return _read(given.where(is_insert), given.where(is_insert | is_delete), key, seq, payload)


def _read(inserts: DataFrame, deletes: DataFrame, key: str, seq: str, payload: Sequence[str]) -> DataFrame:
    newest = insert_rows(inserts, key, seq, payload)
    below = delete_keys(deletes, key, seq).withColumnRenamed(key, "_key")
    return newest.join(below, (F.col(key) == F.col("_key")) & (F.col(seq) < F.col("_deleted_below")), "left_anti")


class ChangeFiles:
    """A table kept as insert files and equality-delete files, in one folder.

    ``append`` writes what a batch adds to insert files and what it removes to delete files, each
    row with its sequence number, in one pass and without a shuffle or a look at the rows that are
    there; one rename of ``FILES.json`` makes both visible. ``read`` keeps the insert rows for which
    there is no later delete key. An update is an insert row and a delete key of its own number,
    which removes smaller numbers only. Batches may come in any order, late or twice.

    ``compact`` folds all files into one insert and one delete batch: only live rows, and per key
    the last delete number, which must stay as long as older inserts may still come. Old files are
    removed after the new list is published. A damaged list is a ``StorageError``.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, seq: str, payload: Sequence[str] = ()):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)
        self.key, self.seq, self.payload = key, seq, list(payload)

    def batches(self) -> list[dict]:
        text = self.files.read_text(f"{self.folder}/FILES.json")
        try:
            return json.loads(text)["batches"] if text is not None else []
        except (ValueError, KeyError, TypeError) as e:
            raise StorageError(f"list of files in {self.folder} is damaged") from e

    def _publish(self, batches: list[dict]) -> None:
        self.files.replace_text(f"{self.folder}/FILES.json", json.dumps({"batches": batches}))

    def append(self, changes: DataFrame, *, is_insert: Column, is_delete: Column) -> str:
        """Adds a batch; its name. Rows that are neither insert nor delete (or null in both), or
        whose key or seq is null, are ignored. An empty batch is fine."""
        if missing := {self.key, self.seq, *self.payload} - set(changes.columns):
            raise SchemaError(f"changes have no column {sorted(missing)[0]}")
        name = f"b-{len(self.batches()):06d}-{uuid.uuid4().hex[:8]}"
        given = changes.where(F.col(self.key).isNotNull() & F.col(self.seq).isNotNull())
        kinds = F.when(is_insert, F.array(F.lit("insert"), F.lit("delete"))).when(is_delete, F.array(F.lit("delete"))).otherwise(F.array().cast("array<string>"))
        rows = given.select(self.key, self.seq, *self.payload, F.explode(kinds).alias("_kind"))
        bare = [F.when(F.col("_kind") == "insert", F.col(c)).alias(c) for c in self.payload]  # a delete file holds keys and numbers
        rows.select(self.key, self.seq, *bare, "_kind").write.partitionBy("_kind").parquet(f"{self.folder}/{name}")
        types = {f.name: f.dataType.simpleString() for f in rows.schema}
        self._publish([*self.batches(), {"name": name, "columns": [[c, types[c]] for c in (self.key, self.seq, *self.payload)]}])
        return name

    def files_of(self, kind: str) -> DataFrame:
        """Rows of all insert files (``insert``) or delete files (``delete``)."""
        batches = self.batches()
        if not batches:
            raise StorageError(f"{self.folder} holds no batch")
        columns = batches[-1]["columns"] if kind == "insert" else batches[-1]["columns"][:2]
        paths = [p for b in batches if self.files.exists(p := f"{self.folder}/{b['name']}/_kind={kind}")]
        schema = ", ".join(f"`{c}` {t}" for c, t in columns)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The live rows: key, seq and payload; insert rows that no later delete key covers."""
        return _read(self.files_of("insert"), self.files_of("delete"), self.key, self.seq, self.payload)

    def compact(self) -> str:
        """Rewrites all batches as one; its name."""
        old = self.batches()
        name = f"b-{len(old):06d}-{uuid.uuid4().hex[:8]}"
        self.read().write.parquet(f"{self.folder}/{name}/_kind=insert")
        delete_keys(self.files_of("delete"), self.key, self.seq).withColumnRenamed("_deleted_below", self.seq).write.parquet(f"{self.folder}/{name}/_kind=delete")
        self._publish([{"name": name, "columns": old[-1]["columns"]}])
        for b in old:
            self.files.remove(f"{self.folder}/{b['name']}")
        return name


def acknowledged_changes(base: DataFrame, entries: DataFrame) -> DataFrame:
    """Base rows and all entries of which some copy was acknowledged: external_id, seq, lifecycle.

    Copies of one number can differ in lifecycle 0 and 2 and in commit_seq, so acknowledgement is
    settled per number first: if any copy has a commit_seq, the entry counts. Of its lifecycles
    the smallest other than 2 stands; rows known to be superseded (2) are never current.
    """
    per = entries.groupBy("seq", "external_id").agg(
        F.max(F.col("commit_seq").isNotNull()).alias("acknowledged"), F.min("lifecycle").alias("lifecycle"))
    return base.select("external_id", "seq", "lifecycle").unionByName(per.where("acknowledged").select("external_id", "seq", "lifecycle"))

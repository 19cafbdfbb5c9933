"""Durable collection: commit log, snapshots, manifest, transactions, recovery.

Layout of a collection's folder::

    collection.json              settings, replaced atomically
    commits/d-<n>-<session>/     staged rows of one write (Parquet)
    commits/c-<n>.json           commit marker: naming a d-folder here is what makes it visible
    commits/history-<n>.json     markers up to the n-th in one file, written at a checkpoint
    snapshots/s-<generation>/    compacted live view (Parquet); index/s-<generation>/ its index
    MANIFEST.json                generation, checkpoint_seq, rows, snapshot, last marker; replaced atomically

Every change has a sequence number. It is not stored with the row but follows from the row's
place (write, partition, position) and the offset that the marker keeps for each partition, so
numbering a distributed batch needs no global sort. A marker itself uses up one number.

Opening removes nothing, whoever opens. Only a checkpoint does: staged folders that no marker
names, generations beyond the last ``KEPT_GENERATIONS``, markers that are in the history and (if
asked for) the pruned log, each once it is older than the lease, so that readers with an older
view and another session's open transaction keep what they hold. A marker is created, never
replaced: of two writers that commit at once the second gets an error and loses nothing else.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from ..errors import SchemaError, StorageError, TransactionError
from ..operators.bounds import broadcast_if_small
from ..operators.liveview import live_view, unknown_keys
from ..schema import DELETE, ID_KINDS, UPSERT, Settings, verdict, violation_counts
from .files import Files

_ROW_BITS = 33
#: Snapshots, with their indexes, that a checkpoint leaves: the new one and the one before.
KEPT_GENERATIONS = 2
#: Seconds for which nothing that an open reader or another session may hold is removed.
LEASE_S = 3600.0


class Store:
    """Files of one collection. One writer at a time; readers see committed states only."""

    def __init__(self, spark: SparkSession, folder: str, lease_s: float = LEASE_S):
        self.spark, self.folder, self.files, self.lease_s = spark, folder.rstrip("/"), Files(spark), lease_s
        self.session = uuid.uuid4().hex[:12]
        self.settings = Settings()
        self.generation, self.checkpoint_seq, self.snapshot_rows, self.snapshot = 0, 0, 0, None
        self.writes: list[dict] = []   # committed writes newer than the snapshot
        self.staged: list[dict] = []   # this handle's writes that aren't committed
        self._load()

    # -- opening -------------------------------------------------------------------------

    def _json(self, name: str) -> dict | None:
        text = self.files.read_text(f"{self.folder}/{name}")
        if text is None:
            return None
        try:
            value = json.loads(text)
        except ValueError as e:
            raise StorageError(f"{name} is damaged") from e
        if not isinstance(value, dict):
            raise StorageError(f"{name} is damaged")
        return value

    def _load(self) -> None:
        """Manifest and snapshot if they're sound, else everything again from the log."""
        if (settings := self._json("collection.json")) is not None:
            try:
                self.settings = Settings(**settings)
            except TypeError as e:
                raise StorageError("collection.json is damaged") from e
        for attempt in range(5):  # a checkpoint may fold markers into the history meanwhile
            names = self.files.names(f"{self.folder}/commits")
            manifest = self._json("MANIFEST.json")
            folded = manifest["last_marker"] if manifest else 0
            fresh = [n for n in names if n.startswith("c-") and n.endswith(".json") and int(n[2:-5]) > folded]
            markers = [self._json(f"commits/{n}") for n in fresh]
            if None not in markers and self._json("MANIFEST.json") == manifest:
                break
        else:
            raise StorageError("the collection changes faster than it can be opened")
        sound = False
        self.next_seq, self._last_marker = 1, max([folded, *(int(n[2:-5]) for n in fresh)])
        if manifest is not None:
            self.generation, self.checkpoint_seq = manifest["generation"], manifest["checkpoint_seq"]
            self.snapshot, self.snapshot_rows = manifest["snapshot"], manifest["rows"]
            self.next_seq = self.checkpoint_seq + 1
            sound = self._snapshot_sound()
            if not sound:
                if self.settings.pruned:
                    raise StorageError(f"snapshot {self.snapshot} is unreadable and the log was pruned")
                markers = self._history(folded) + markers
                self.snapshot, self.checkpoint_seq, self.snapshot_rows = None, 0, 0
        self.writes = [w for m in markers for w in m["writes"]]
        for w in self.writes:
            if w["rows"] and w["dir"] not in names:
                raise StorageError(f"committed write {w['dir']} is missing")
        if manifest is not None and not sound:
            self._check_log()
        self.next_seq = max([self.next_seq, *(m["seq"] + 1 for m in markers)])
        self._last_dir = max([0, *(int(n.split("-")[1]) for n in names if n.startswith("d-"))])

    def _check_log(self) -> None:
        """Before the log takes a lost snapshot's place: every committed row must be there. Parquet's own
        checksums cover what is in a file."""
        try:
            found = self.log().count()
        except PySparkException as e:
            raise StorageError("the log of changes can't be read") from e
        if found != (want := sum(w["rows"] for w in self.writes)):
            raise StorageError(f"the log holds {found} of {want} committed rows")

    def _history(self, upto: int) -> list[dict]:
        """Markers that were folded into one file. Only a lost snapshot and a checkpoint need them."""
        if not upto:
            return []
        folded = self._json(f"commits/history-{upto:08d}.json")
        if folded is None:
            raise StorageError("the history of commits is missing")
        return folded["markers"]

    def _snapshot_sound(self) -> bool:
        try:
            return self._read_snapshot().count() == self.snapshot_rows
        except (PySparkException, StorageError):
            return False

    # -- reading -------------------------------------------------------------------------

    def _row_type(self) -> str:
        return self.settings.row_type()

    def _read_snapshot(self) -> DataFrame:
        path = f"{self.folder}/snapshots/{self.snapshot}"
        if not self.files.exists(path):
            raise StorageError(f"snapshot {self.snapshot} is missing")
        return self.spark.read.schema(f"{self._row_type()}, seq bigint").parquet(path)

    def log(self) -> DataFrame:
        """Changes newer than the snapshot, this handle's own uncommitted ones included."""
        writes = [w for w in self.writes + self.staged if w["rows"]]
        if not writes:
            return self.spark.createDataFrame([], f"{self._row_type()}, op string, seq bigint")
        rows = self.spark.read.schema(f"{self._row_type()}, op string, _c int, _p int, _r bigint").parquet(*[f"{self.folder}/commits/{w['dir']}" for w in writes])
        starts = self.spark.createDataFrame([(int(w["dir"].split("-")[1]), int(p), o) for w in writes for p, o in w["offsets"].items()], "_c int, _p int, _o bigint")
        numbered = rows.join(broadcast_if_small(starts, 32), ["_c", "_p"])
        return numbered.select(*rows.columns[: -3], (F.col("_o") + F.col("_r")).alias("seq"))

    def live(self) -> DataFrame:
        """The current record per id, tombstones applied; seq included."""
        log, cols = self.log(), [c.split(" ")[0].strip("`") for c in self._row_type().split(", ")]
        if self.snapshot is None:
            every = log
        elif not (self.writes or self.staged):
            return self._read_snapshot()
        else:
            every = self._read_snapshot().withColumn("op", F.lit(UPSERT)).unionByName(log)
        return live_view(every, "id", "seq", F.col("op") == UPSERT).select(*self._columns(cols), "seq")

    def _columns(self, cols: list[str]) -> list[str]:
        return ["id", "vector", "norm", "text", *self.settings.meta_columns()]

    def sealed_and_tail(self) -> tuple[DataFrame | None, DataFrame]:
        """The snapshot, and the newer changes reduced to the latest per id (op still there)."""
        from ..operators.liveview import latest

        return (self._read_snapshot() if self.snapshot else None), latest(self.log(), "id", "seq")

    # -- writing -------------------------------------------------------------------------

    def save_settings(self) -> None:
        self.files.make(self.folder)
        self.files.replace_text(f"{self.folder}/collection.json", json.dumps(self.settings.to_json()))

    def stage(self, rows: DataFrame, op: str, before_accept: Callable[[DataFrame], None] | None = None) -> int:
        """Writes a batch without making it visible to others; returns its last number.

        The whole batch is checked first; one faulty row refuses all of it.
        """
        self._last_dir += 1
        name = f"d-{self._last_dir:08d}-{self.session}"
        path = f"{self.folder}/commits/{name}"
        seen = Observation()
        placed = rows.withColumns({"op": F.lit(op), "_c": F.lit(self._last_dir), "_p": F.spark_partition_id(), "_r": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))})
        placed.observe(seen, *violation_counts(self.settings)).write.mode("overwrite").parquet(path)  # checked while it is written
        written = self.spark.read.schema(f"{self._row_type()}, op string, _c int, _p int, _r bigint").parquet(path)
        try:
            faults, dim = verdict(seen.get, self.settings)
            if faults:
                raise SchemaError("batch refused: " + ", ".join(f"{v} x {k}" if k != "wrong dimension" else k for k, v in faults.items()))
            if before_accept:
                before_accept(written)
        except SchemaError:
            self.files.remove(path)
            raise
        if op == UPSERT and self.settings.dim is None:
            self.settings.dim = dim
        sizes = sorted((r["_p"], r["n"]) for r in written.groupBy("_p").agg((F.max("_r") + 1).alias("n")).collect())  # one row per written file
        offsets, at = {}, self.next_seq
        for p, n in sizes:
            offsets[str(p)] = at
            at += n
        self.next_seq = at
        self.staged.append({"dir": name, "rows": sum(n for _, n in sizes), "offsets": offsets})
        return at - 1

    def commit(self) -> int:
        """Publishes what is staged by one rename; returns the number of the barrier.

        ``StorageError`` if a staged folder is gone or another writer has committed meanwhile;
        nothing is published then, and the staged writes stay for ``rollback``.
        """
        there = set(self.files.names(f"{self.folder}/commits"))
        for w in self.staged:
            if w["dir"] not in there:
                raise StorageError(f"staged write {w['dir']} is missing")
        self.save_settings()
        self.files.make(f"{self.folder}/commits")
        manifest = self._json("MANIFEST.json")
        if manifest and manifest["generation"] != self.generation:
            raise StorageError("another writer made a checkpoint since this handle was opened")
        self.files.create_text(f"{self.folder}/commits/c-{self._last_marker + 1:08d}.json", json.dumps({"seq": self.next_seq, "writes": self.staged}))
        seq, self.next_seq = self.next_seq, self.next_seq + 1
        self._last_marker += 1
        self.writes, self.staged = self.writes + self.staged, []
        return seq

    def rollback(self) -> None:
        """Forgets what is staged. Committed versions were never touched."""
        for w in self.staged:
            self.files.remove(f"{self.folder}/commits/{w['dir']}")
        had_settings = self._json("collection.json")
        self.staged = []
        self.settings = Settings(**had_settings) if had_settings else Settings(metric=self.settings.metric, fields=self.settings.fields)

    def delete(self, ids: DataFrame) -> int:
        """Stages tombstones; unknown or dead ids refuse the whole batch."""
        def known(written: DataFrame) -> None:
            bad = [r["id"] for r in unknown_keys(written, self.live().select("id"), "id").limit(5).collect()]
            if bad:
                raise SchemaError(f"can't delete unknown ids, such as {bad}")

        empty = [F.lit(None).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in self._row_type().replace("`", "").split(", ")) if n != "id"]
        return self.stage(ids.select("id", *empty), DELETE, known)

    def checkpoint(self, prune_log: bool = False) -> int:
        """Commits, compacts the live view to a new snapshot, publishes it; returns the generation.

        The log stays, so that a lost snapshot can be rebuilt, unless ``prune_log``. What is removed
        is older than the lease: see the head of this module.
        """
        barrier = self.commit()
        generation = self.generation + 1
        name = f"s-{generation:08d}"
        self.live().write.mode("overwrite").parquet(f"{self.folder}/snapshots/{name}")
        rows = self.spark.read.schema(f"{self._row_type()}, seq bigint").parquet(f"{self.folder}/snapshots/{name}").count()
        folded = (self._json("MANIFEST.json") or {}).get("last_marker", 0)
        if prune_log and not self.settings.pruned:
            self.settings.pruned = True
            self.save_settings()
        markers = [] if self.settings.pruned else self._history(folded) + [self._json(f"commits/c-{n:08d}.json") for n in range(folded + 1, self._last_marker + 1)]
        self.files.replace_text(f"{self.folder}/commits/history-{self._last_marker:08d}.json", json.dumps({"markers": markers}))
        manifest = {"generation": generation, "checkpoint_seq": barrier, "rows": rows, "snapshot": name, "last_marker": self._last_marker, "dim": self.settings.dim, "id_kind": self.settings.id_kind, "metric": self.settings.metric}
        self.files.replace_text(f"{self.folder}/MANIFEST.json", json.dumps(manifest))
        self.generation, self.checkpoint_seq, self.snapshot, self.snapshot_rows, self.writes = generation, barrier, name, rows, []
        self._clean({w["dir"] for m in markers for w in m["writes"]})
        return generation

    def _clean(self, logged: set[str]) -> None:
        """Removes what the current state doesn't need, if it is older than the lease."""
        mine = {w["dir"] for w in self.staged}
        old = [f"commits/{n}" for n in self.files.names(f"{self.folder}/commits")
               if (n.startswith("d-") and n not in logged and n not in mine) or (n.startswith("c-") and n.endswith(".json") and int(n[2:-5]) <= self._last_marker)
               or (n.startswith("history-") and n != f"history-{self._last_marker:08d}.json")]
        for folder in ("snapshots", "index"):
            old += [f"{folder}/{n}" for n in self.files.names(f"{self.folder}/{folder}") if int(n.split("-")[1]) <= self.generation - KEPT_GENERATIONS]
        for path in old:
            if self.files.age_s(f"{self.folder}/{path}") >= self.lease_s:
                self.files.remove(f"{self.folder}/{path}")


__all__ = ["ID_KINDS", "Store", "TransactionError"]

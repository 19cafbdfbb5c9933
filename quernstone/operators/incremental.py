"""Processing only what is new since the last successful run.

``IncrementalRun`` runs a job over the entries that are acknowledged up to a limit fixed at the
start and that no earlier run has processed, and publishes output and watermark by one atomic
rename. It can start from a manifest of another writer: what that covers counts as processed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import SchemaError, StorageError
from ..sources.files import Files
from .bounds import broadcast_if_small


def last_good_manifest(manifests: DataFrame) -> DataFrame:
    """The published manifest of highest generation: generation, checkpoint_seq, segments (one row).

    Repeated publications of a generation: the one with the highest checkpoint_seq, then the
    most segments. Rows with a null generation don't count. None published: no row.
    """
    best = F.max(F.struct("generation", F.coalesce("checkpoint_seq", F.lit(-1)).alias("checkpoint_seq"), F.size("segments"), F.col("segments")))
    one = manifests.where((F.col("status") == "published") & F.col("generation").isNotNull()).agg(best.alias("m")).where("m is not null")
    return one.select("m.generation", "m.checkpoint_seq", F.coalesce("m.segments", F.array().cast("array<string>")).alias("segments"))


def uncovered(entries: DataFrame, checkpoint_seq: int | None, segments: DataFrame | None, *, key: Sequence[str] = ("seq", "external_id"), low: int | None = None, high: int | None = None,
              columns: Sequence[str] = (), number: str = "seq", commit: str = "commit_seq", segment: str = "segment") -> DataFrame:
    """Acknowledged entries that a manifest doesn't cover, one row per key: the key and ``columns``.

    An entry is all copies of one key. It is acknowledged if a copy has a commit number (above ``low``
    and of at most ``high``, if given), and covered if its number is not above ``checkpoint_seq`` and a copy lies in
    one of ``segments`` (one column; repeats are harmless). A null segment is in none. Without
    ``segments`` nothing is covered; a null ``checkpoint_seq`` is below all. Rows with a null key
    are left out. ``columns`` come from the copy that was acknowledged first.

    The list of segments, as long as the log has files, is joined by hash: broadcast if a count
    proves that it is small. Copies are merged by an aggregate with map-side combine.
    """
    rows = entries.where(" and ".join(f"`{k}` is not null" for k in key))
    seen = F.col(commit).isNotNull()
    seen = seen if low is None else seen & (F.col(commit) > F.lit(low))
    seen = seen if high is None else seen & (F.col(commit) <= F.lit(high))
    parts = [F.max(F.coalesce(seen, F.lit(False))).alias("_acked"), F.min(F.when(seen, F.col(commit))).alias("_first")]
    if columns:
        parts.append(F.min_by(F.struct(*[F.col(c).alias(c) for c in columns]), F.when(seen, F.col(commit))).alias("_row"))
    due = F.col("_acked")
    if segments is not None:
        listed = segments.select(F.col(segments.columns[0]).alias("_segment")).where("_segment is not null").distinct()
        rows = rows.join(broadcast_if_small(listed, 256).withColumn("_listed", F.lit(True)), F.col(segment) == F.col("_segment"), "left")
        above = F.lit(True) if checkpoint_seq is None else F.col(number) > F.lit(checkpoint_seq)
        parts += [F.max(above).alias("_above"), F.max(F.coalesce("_listed", F.lit(False))).alias("_sealed")]
        due = due & (F.col("_above") | ~F.col("_sealed"))
    per = rows.groupBy(*key).agg(*parts).where(due)
    return per.select(*key, *[F.col("_row")[c].alias(c) for c in columns if c not in key], "_first")


class IncrementalRun:
    """Runs ``job`` over what is new; every entry goes to exactly one published run.

    An entry is all rows of one ``key``. It is new if a copy of it is acknowledged (``commit_col``
    not null) at or below the upper limit, the highest number found when the run starts, and no
    published run has had it. That doesn't depend on the order of arrival: a copy acknowledged
    again later is not processed again, and an entry that arrives with a commit number below the
    watermark isn't skipped. ``lateness`` bounds the search for both at scale: all copies of an
    entry arrive before the watermark is that many commits above its first acknowledgement. Only
    rows above watermark - lateness are read then, and only keys above watermark - 2 * lateness
    compared. None, the default, compares with all keys ever published.

    Files: ``in/run-<n>`` holds the entries of a run, ``out/run-<n>`` what the job made of them, and
    ``WATERMARK.json`` names watermark and last run. The entries are written first; job and keys are
    taken from that copy, so a source that grows meanwhile can't make them differ. Replacing the
    JSON by a rename then publishes output, keys and watermark together. A run that dies before
    that leaves folders that nobody reads; the next one writes them anew. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, *, key: Sequence[str] = ("seq",), commit_col: str = "commit_seq", lateness: int | None = None):
        if lateness is not None and lateness < 0:
            raise SchemaError("lateness can't be negative")
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark)
        self.key, self.commit_col, self.lateness = tuple(key), commit_col, lateness

    def state(self) -> dict:
        """watermark, run (number of the last one), oldest (first run whose keys are needed), base."""
        text = self.files.read_text(f"{self.folder}/WATERMARK.json")
        if text is None:
            return {"watermark": None, "run": 0, "oldest": 1, "base": None}
        try:
            return json.loads(text)
        except ValueError as e:
            raise StorageError(f"watermark file in {self.folder} is damaged") from e

    def _publish(self, state: dict) -> None:
        self.files.make(self.folder)
        self.files.replace_text(f"{self.folder}/WATERMARK.json", json.dumps(state))

    def start_from(self, manifest: DataFrame, number_col: str = "seq", segment_col: str = "segment") -> None:
        """Takes what a manifest covers as processed: one row of checkpoint_seq and segments (see
        ``last_good_manifest``); without a row nothing is. Only before the first run."""
        if self.state()["run"]:
            raise StorageError("runs were published already")
        row = manifest.select("checkpoint_seq").first()  # at most one row
        if row is not None:
            manifest.select(F.explode("segments").alias("segment")).write.mode("overwrite").parquet(f"{self.folder}/base")
        base = None if row is None else {"checkpoint_seq": row[0], "number": number_col, "segment": segment_col}
        self._publish({**self.state(), "base": base})

    def pending(self, source: DataFrame, columns: Sequence[str] | None = None) -> tuple[DataFrame, int | None]:
        """New entries, one row each with the key and ``columns`` (default: all of the source), and
        the upper limit, fixed now; None if nothing was ever acknowledged."""
        missing = {self.commit_col, *self.key} - set(source.columns)
        if missing:
            raise SchemaError(f"source has no column {sorted(missing)[0]}")
        state, commit = self.state(), F.col(self.commit_col)
        columns = list(source.columns if columns is None else columns)
        low = None if self.lateness is None or state["watermark"] is None else state["watermark"] - self.lateness
        base = state["base"]
        reach = None if low is None else low - self.lateness if base else low  # what was covered shows in copies as late as that
        rows = source if low is None else source.where(commit.isNull() | (commit > F.lit(reach)))
        high = rows.agg(F.max(commit)).first()[0]
        high = high if state["watermark"] is None else max(state["watermark"], high if high is not None else state["watermark"])
        names = {"number": base["number"], "segment": base["segment"]} if base else {}
        segments = self.spark.read.schema("segment string").parquet(f"{self.folder}/base") if base else None
        # The key alone needs no row of its first copy, so nothing else is read or shuffled.
        found = uncovered(rows, base and base["checkpoint_seq"], segments, key=self.key, low=low, high=high, columns=[c for c in columns if c not in self.key], commit=self.commit_col, **names)
        old = [n for n in range(state["oldest"], state["run"] + 1)]
        if old:
            keys = self.spark.read.parquet(*[f"{self.folder}/in/run-{n:06d}" for n in old])
            if low is not None:
                keys = keys.where(F.col("_first") > F.lit(low - self.lateness))
            found = found.join(keys.select(*self.key), list(self.key), "left_anti")
        return found.select(*[c for c in self.key if c not in columns], *columns, "_first"), high

    def run(self, source: DataFrame, job: Callable[[DataFrame], DataFrame], columns: Sequence[str] | None = None, before_publish: Callable[[], None] | None = None) -> int:
        """Processes what is pending; the number of the run, or 0 if there was nothing.

        ``before_publish`` is called between output and publication (for tests of failures).
        """
        state = self.state()
        rows, high = self.pending(source, columns)
        if high is None:
            return 0
        n = state["run"] + 1
        given = f"{self.folder}/in/run-{n:06d}"
        rows.write.mode("overwrite").parquet(given)
        rows = self.spark.read.schema(rows.schema).parquet(given)
        if rows.isEmpty() and n > 1:
            return 0
        job(rows.drop("_first")).write.mode("overwrite").parquet(f"{self.folder}/out/run-{n:06d}")
        if before_publish:
            before_publish()
        oldest = state["oldest"]
        if self.lateness is not None:
            reach = high - 2 * self.lateness
            while oldest < n and (top := self.spark.read.parquet(f"{self.folder}/in/run-{oldest:06d}").agg(F.max("_first")).first()[0]) is not None and top <= reach:
                oldest += 1  # no copy of its keys can come any more
        self._publish({"watermark": high, "run": n, "oldest": oldest, "base": state["base"]})
        for gone in range(state["oldest"], oldest):
            self.files.remove(f"{self.folder}/in/run-{gone:06d}")
        return n

    def result(self) -> DataFrame:
        """Output of all published runs: their numbers have no gaps."""
        last = self.state()["run"]
        if not last:
            raise StorageError(f"{self.folder} holds no published run")
        return self.spark.read.parquet(*[f"{self.folder}/out/run-{n:06d}" for n in range(1, last + 1)])

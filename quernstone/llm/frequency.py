"""Frequency of every term: occurrences and records, with last-seen counters.

Tokens (record, term, count within the text) are hash-partitioned by term and ordered by record
within each partition. A task goes through them once and keeps for each term how often it occurred,
in how many records, and the last record it was seen in: an occurrence adds a record only if it
comes from another one, so no set of records is ever held, and a repeated row is known by its
place next to its twin. As records come in order, only terms of the present record need their
last-seen entry; when too many terms are held, all counts are passed on and these entries kept.

A term of very many records would go to one task. So the hash also takes a part number that follows
from the record: all tokens of a term and a record stay together, a term's records are spread over
several counters, and their counts add up by term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.text import term_counts
from ..operators.bounds import spread

#: Terms that a task holds before it passes their counts on.
HELD_TERMS = 500_000


def term_frequencies(records: DataFrame, *, rare_below: int = 3, common_share: float = 0.1, id_col: str = "external_id", text_col: str = "text", held: int = HELD_TERMS) -> DataFrame:
    """term, occurrences, records, mark of every distinct word.

    ``mark`` is ``rare`` if fewer than ``rare_below`` records hold the word, ``common`` if more
    than ``common_share`` of all records do, else null; rare wins where both hold. All records
    count in that share, also those without text. Repeated rows count once (same id and text); an id
    with several texts is one record that holds the words of all. Rows with a null id are left out.
    An empty table gives no rows. Extra columns are not read.

    Texts are cut and counted where they are read; they are never shuffled.
    """
    if rare_below < 0 or not 0 <= common_share <= 1 or held < 1:
        raise ValueError("rare_below can't be negative, common_share lies in [0, 1], held is at least 1")
    rows = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    n = rows.agg(F.count_distinct("id").alias("_n"))  # one row
    tokens = term_counts(spread(rows.withColumn("h", F.xxhash64("text"))), "text", "id", "h").select("term", "id", "h", "tf")
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    ordered = tokens.repartition("term", F.pmod(F.xxhash64("id"), F.lit(parts))).sortWithinPartitions("id", "h")
    counts = ordered.mapInArrow(_counter(held), "term string, occurrences long, records long").groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("_n") * F.lit(common_share), "common")
    return counts.crossJoin(F.broadcast(n)).select("term", "occurrences", "records", mark.alias("mark"))


class LastSeen:
    """Occurrences, records and last record of each term, for tokens that come by record."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.occurrences, self.records = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.last = np.zeros((0, 2), np.int64)  # record and text
        self.seen = np.zeros(0, bool)

    def add(self, terms: pa.Array, ids: np.ndarray, texts: np.ndarray, tf: np.ndarray) -> None:
        coded = terms.dictionary_encode()
        known = len(self.place)
        at = np.array([self.place.setdefault(t, len(self.place)) for t in coded.dictionary.to_pylist()], np.int64)
        if (more := len(self.place) - known) > 0:
            self.occurrences, self.records = (np.concatenate((x, np.zeros(more, np.int64))) for x in (self.occurrences, self.records))
            self.last, self.seen = np.concatenate((self.last, np.zeros((more, 2), np.int64))), np.concatenate((self.seen, np.zeros(more, bool)))
        codes = at[coded.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(codes, kind="stable")  # by term; a term's records stay in their order
        codes, now, tf = codes[order], np.stack((ids, texts), 1)[order], tf[order]
        first = np.diff(codes, prepend=-1) != 0
        before = np.concatenate((now[:1], now[:-1]))
        before[first] = self.last[codes[first]]
        met = ~first | self.seen[codes]
        same = met & (now[:, 0] == before[:, 0])
        twin = same & (now[:, 1] == before[:, 1])
        self.occurrences += np.bincount(codes[~twin], tf[~twin], len(self.place)).astype(np.int64)
        self.records += np.bincount(codes[~same], minlength=len(self.place))
        end = np.append(np.flatnonzero(first)[1:] - 1, len(codes) - 1)
        self.last[codes[end]], self.seen[codes[end]] = now[end], True

    def take(self, record: int | None) -> pa.RecordBatch:
        """All counts so far, which start anew; last-seen entries of ``record`` stay."""
        out = pa.RecordBatch.from_arrays([pa.array(list(self.place), pa.string()), pa.array(self.occurrences), pa.array(self.records)], ["term", "occurrences", "records"])
        keep = np.flatnonzero(self.last[:, 0] == record) if record is not None else np.zeros(0, np.int64)
        terms = out.column("term").take(pa.array(keep)).to_pylist()
        last = self.last[keep]
        self.__init__()
        self.place = {t: i for i, t in enumerate(terms)}
        self.occurrences, self.records = np.zeros(len(keep), np.int64), np.zeros(len(keep), np.int64)
        self.last, self.seen = last, np.ones(len(keep), bool)
        return out.filter(pa.array(out.column("occurrences").to_numpy() > 0))


def _counter(held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = LastSeen()
        for b in batches:
            if not b.num_rows:
                continue
            ids, texts, tf = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "h", "tf"))
            counts.add(b.column("term"), ids, texts, tf)
            if len(counts.place) > held:
                yield counts.take(int(ids[-1]))
        if counts.place:
            yield counts.take(None)

    return run

"""Encoding of texts by a public byte-level BPE vocabulary given as ranks.

A text is cut by the vocabulary's pattern; each piece is merged on its own. A piece is held as
contiguous arrays: part boundaries (the id of the part that starts there) and the rank of each
part with its right neighbour. The lowest rank is found by a scan, its right boundary is deleted
and the two neighbouring ranks are looked up again, until no pair has a rank. Pieces are short,
so scanning beats a heap; and many pieces of a batch are merged side by side, one row each.
Long pieces (a run of one character can be as long as a text) take a heap instead.

Most pieces of a corpus are repeats: each worker keeps the ids of those it has seen, up to a
bound, and only new ones are merged.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from ..operators.bounds import spread

#: Byte length up to which a piece is merged in the array; longer ones use a heap.
SHORT = 48
#: Pieces that a worker remembers.
REMEMBERED = 400_000

_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of byte strings and, for pairs of ids, the rank of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = np.fromiter(pairs.values(), np.int32, len(pairs))[order]

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        """From a file with a line for each token: base64 of its bytes, its rank."""
        with open(path, "rb") as f:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.values[at], _NONE)

    def merge_short(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece of at most ``SHORT`` bytes; pieces of similar length side by side."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            by_width.setdefault(-(-len(p) // 4) * 4, []).append(i)
        for width, which in by_width.items():
            raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in which), np.uint8).reshape(-1, width)
            size = np.fromiter((len(pieces[i]) for i in which), np.int64, len(which))
            parts = np.where(np.arange(width) < size[:, None], self.byte_id[raw], -1)
            for i, ids in zip(which, self._merge_rows(parts, size)):
                out[i] = ids
        return out

    def _merge_rows(self, parts: np.ndarray, size: np.ndarray) -> list[list[int]]:
        """``parts`` holds ``size`` ids a row, then -1, which no pair has a rank with."""
        n, width = parts.shape
        ranks = np.full((n, width), _NONE, np.int32)
        ranks[:, :-1] = self.pair_ranks(parts[:, :-1], parts[:, 1:])
        done, at_row, column = [], np.arange(n), np.arange(width)
        while n:
            row = np.arange(n)
            at = ranks.argmin(1)
            best = ranks[row, at]
            more = best != _NONE
            if not more.all():
                done.append((at_row[~more], parts[~more]))
                parts, ranks, at_row, at, best = parts[more], ranks[more], at_row[more], at[more], best[more]
                n = len(parts)
                row = np.arange(n)
                if not n:
                    break
            # The left part becomes the merged one; all right of the deleted boundary moves up.
            source = np.minimum(column + (column > at[:, None]), width - 1) + row[:, None] * width
            parts, ranks = parts.ravel()[source], ranks.ravel()[source]
            parts[:, -1], ranks[:, -1] = -1, _NONE
            parts[row, at] = best
            ranks[row, at] = self.pair_ranks(best, parts[row, np.minimum(at + 1, width - 1)])
            inner = np.flatnonzero(at)
            ranks[inner, at[inner] - 1] = self.pair_ranks(parts[inner, at[inner] - 1], best[inner])
        out: list = [None] * len(size)
        for rows, p in done:
            for i, ids, length in zip(rows.tolist(), p.tolist(), (p >= 0).sum(1).tolist()):
                out[i] = ids[:length]
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merges by a heap over linked parts, n log n in the piece's length."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after, gone = list(range(-1, n - 1)), list(range(1, n + 1)), bytearray(n)
        lookup = dict(zip(self.keys.tolist(), self.values.tolist())) if not hasattr(self, "_lookup") else self._lookup
        self._lookup = lookup
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := lookup.get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i] if not gone[i] else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], gone[j], after[i] = rank, 1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := lookup.get((rank << 32) | ids[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if before[i] >= 0 and (r := lookup.get((ids[before[i]] << 32) | rank)) is not None:
                heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
        return [t for t, dead in zip(ids, gone) if not dead]


class Encoder:
    """Encodes batches of texts; remembers pieces between batches."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, remembered: int = REMEMBERED):
        self.vocabulary, self.remembered = vocabulary, remembered
        self.cut = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.start, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text (0 for null and empty)."""
        if len(self.known) > self.remembered:
            self._forget()
        pieces, sizes = [], []
        for text in texts:
            some = self.cut(text) if text else []
            pieces += some
            sizes.append(len(some))
        self._learn(set(pieces).difference(self.known))
        code = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        per = self.length[code]
        ends = np.concatenate(([0], np.cumsum(per)))
        ids = self.flat[np.repeat(self.start[code] - ends[:-1], per) + np.arange(ends[-1])]
        return ids, np.diff(ends[np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))])

    def _learn(self, new: set[str]) -> None:
        pieces = list(new)
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        ids: list = [self.vocabulary.ranks.get(b) for b in raw]
        short = [i for i, b in enumerate(raw) if ids[i] is None and len(b) <= SHORT]
        merged = dict(zip(short, self.vocabulary.merge_short([raw[i] for i in short])))
        ids = [merged[i] if i in merged else [t] if t is not None else self.vocabulary.merge_long(raw[i]) for i, t in enumerate(ids)]
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.flat = np.concatenate((self.flat, np.fromiter((t for x in ids for t in x), np.int32, int(length.sum()))))


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    """One encoder for all tasks that a worker process runs."""
    return Encoder(Vocabulary.load(path), pattern)


def encode(documents: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", batch: int = 1024) -> DataFrame:
    """doc_id, ids: token ids of every row's text, in order, without special tokens.

    Null and empty texts give an empty list. One row out per row in: repeated rows come again, a
    null id stays null. ``vocabulary`` is the path of the rank file, which every executor must
    be able to read. Strings that look like special tokens are ordinary text. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, pattern)
        for whole in batches:
            for s in range(0, whole.num_rows, batch):
                b = whole.slice(s, batch)
                ids, sizes = encoder.encode(b.column("text").to_pylist())
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["doc_id", "ids"])

    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return spread(rows).mapInArrow(run, "doc_id long, ids array<int>")

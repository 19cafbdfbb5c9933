"""Evaluation texts in a corpus: CGK embedding, bit-sampling LSH, exact edit verification.

A test item is cut into all passages of ``window`` words, and a document into all its windows of
that size. Each is a string over words. The CGK walk turns it into a longer string such that
edit distance becomes Hamming distance: at step j it writes the word under its cursor, and a
random bit of (j, word) says whether the cursor moves on. Two strings that differ by an edit fall
out of step there and drift together again. Bit sampling then takes a few places of the walk as
a key; passages and windows with an equal key are candidates, and their true edit distance in
words decides. Several keys (from independent walks) reach the wanted recall; for ``max_edit`` 0
equal strings have equal walks, so one key finds all of them.

Item-sized windows would ask for whole items: a document that holds ten words of a long item is
many edits away from it. Passages of the wanted length find those too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.bounds import spread

#: The word rule of the text functions, in this module's regular expressions.
WORD = r"[\p{Alphabetic}\p{N}]+"
#: Places of the walk that make up a key.
SAMPLED = 6
#: Passages of one pass over the corpus; more items are searched in blocks.
PASSAGES = 1_000_000
_END = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64((salt * 0x632BE59BD9B4E019) & (2**64 - 1))) * _ODD
        h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(32))


def lower(word: str) -> str:
    """Lower case letter by letter; the whole-string rule for final sigma must not apply."""
    return word.replace("Σ", "σ").lower()


class Words:
    """Hashes of raw words, remembered between batches up to a bound."""

    def __init__(self, remembered: int = 500_000):
        self.find, self.remembered = regex.compile(WORD).findall, remembered
        self.code: dict[str, int] = {}
        self.hashes = np.empty(0, np.uint64)

    def split(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Raw words of all texts, their hashes (of the lower-case form), and each text's count."""
        if len(self.code) > self.remembered:
            self.code, self.hashes = {}, np.empty(0, np.uint64)
        raw, sizes = [], []
        for t in texts:
            some = self.find(t) if t else []
            raw += some
            sizes.append(len(some))
        new = list(set(raw).difference(self.code))
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
        made = np.fromiter((xxhash.xxh3_64_intdigest(lower(w).encode("utf-8", "surrogatepass")) for w in new), np.uint64, len(new))
        self.hashes = np.concatenate((self.hashes, made))
        return raw, self.hashes[np.fromiter(map(self.code.__getitem__, raw), np.int64, len(raw))], np.array(sizes, np.int64)


def window_starts(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window of that many words fits into one text, and the text of each."""
    first = np.cumsum(sizes) - sizes
    fits = np.maximum(sizes - window + 1, 0)
    text = np.repeat(np.arange(len(sizes)), fits)
    return first[text] + np.arange(len(text)) - np.repeat(np.cumsum(fits) - fits, fits), text


def sampled_places(window: int, table: int, seed: int) -> np.ndarray:
    """Which steps of the walk table ``table`` looks at. A walk takes about 2 * window steps to its
    end, behind which all walks are alike, so later steps would tell nothing."""
    return np.sort(np.random.default_rng((seed, table)).permutation(2 * window)[:SAMPLED])


def walk_keys(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, table: int, seed: int) -> np.ndarray:
    """Key of the words from each start to its end: the sampled places of their own CGK walk."""
    places = set(sampled_places(window, table, seed).tolist())
    bits = _mix(hashes, seed * 1009 + table + 1)  # bit j of a word's number moves the cursor at step j
    more = _mix(hashes, seed * 1009 + table + 7_001) if 2 * window > 64 else bits
    key = np.full(len(starts), seed + table + 1, np.uint64)
    at, top = starts.copy(), np.maximum(len(hashes) - 1, 0)
    with np.errstate(over="ignore"):
        for j in range(max(places) + 1):
            here = np.minimum(at, top)
            if j in places:
                out = np.where(at < ends, hashes[here], _END)
                key = (key ^ out) * _ODD
                key ^= key >> np.uint64(29)
            step = ((bits if j % 128 < 64 else more)[here] >> np.uint64(j % 64)) & np.uint64(1)
            at = np.minimum(at + step.astype(np.int64), ends)
    return key


def simulated_hits(window: int, max_edit: int, table: int, seed: int, trials: int = 3000) -> np.ndarray:
    """Which of many random strings keep their key under ``max_edit`` random edits inside a text."""
    rng = np.random.default_rng((seed, window, max_edit))
    word = lambda: int(rng.integers(1, 2**62))
    a = rng.integers(1, 2**62, (trials, window))
    b = []
    for row in a.tolist():
        s = row
        for _ in range(max_edit):
            i, kind = int(rng.integers(window)), int(rng.integers(3))
            s = s[:i] + ([word()] if kind == 0 else [word(), *s[i : i + 1]] if kind == 1 else []) + s[i + 1 :]
        b.append([*s, *(word() for _ in range(max_edit))][:window])  # text goes on behind it
    starts = np.arange(trials) * window
    ka, kb = (walk_keys(np.asarray(x, np.uint64).ravel(), starts, starts + window, window, table, seed) for x in (a, b))
    return ka == kb


def tables_for(window: int, max_edit: int, target_recall: float, seed: int = 1, most: int = 256) -> int:
    """Tables needed to meet the recall, by simulation: where an edit lies decides how likely all
    tables miss it, so their misses don't just multiply."""
    if max_edit == 0:
        return 1
    want = target_recall + (1 - target_recall) / 4  # for the error of the simulation
    hit = np.zeros(1, bool)
    for n in range(1, most + 1):
        hit = hit | simulated_hits(window, max_edit, n - 1, seed)
        if hit.mean() >= want:
            return n
    raise ValueError(f"{most} tables don't reach a recall of {target_recall} for {max_edit} edits in {window} words")


def edit_distances(a: np.ndarray, b: np.ndarray, slack: int = 0) -> np.ndarray:
    """Smallest Levenshtein distance of each row of ``a`` to a beginning of the same row of ``b``
    that is at most ``slack`` words shorter or longer; dynamic programming over all rows at once."""
    n, w = a.shape
    row = np.tile(np.arange(b.shape[1] + 1), (n, 1))
    for i in range(w):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        best = np.minimum(row[:, :-1] + (a[:, i : i + 1] != b), row[:, 1:] + 1)
        for j in range(b.shape[1]):
            new[:, j + 1] = np.minimum(best[:, j], new[:, j] + 1)
        row = new
    return row[:, max(0, w - slack) : w + slack + 1].min(1)


def leaked_items(documents: DataFrame, items: DataFrame, *, window: int = 10, max_edit: int = 0, target_recall: float = 0.95, seed: int = 1,
                 doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", passages: int = PASSAGES) -> DataFrame:
    """doc_id, item_id of every document and item that share a passage: some ``window`` consecutive
    words of the item stand in the document with at most ``max_edit`` words inserted, removed or
    changed. Each pair once.

    For ``max_edit`` 0 the result is exact. Otherwise each reported pair is true, and a pair that
    differs by random edits is found with ``target_recall`` or more, as more of its windows match.
    Null, empty and shorter texts share nothing; rows with a null id are left out; repeated rows
    count once; extra columns are not read. No items or no documents: no rows.

    Items are the bounded side: blocks of at most about ``passages`` passages go to every task, and
    each block is one pass over the documents. Documents are never shuffled, nor are their windows.
    """
    if window < 1 or max_edit < 0 or max_edit >= window or not 0 < target_recall < 1:
        raise ValueError("window is at least 1, max_edit below it, target_recall in (0, 1)")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    docs = spread(docs)
    given = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null").distinct()
    tables = tables_for(window, max_edit, target_recall, seed)
    chars = given.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-(chars // 4) * tables // passages))  # words have about five characters with their gaps
    found = []
    for b in range(blocks):
        block = given.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow()
        index = _Index(block["item_id"].to_numpy(), block["text"].to_pylist(), window, tables, seed)
        found.append(docs.mapInArrow(_searcher(index, max_edit), "doc_id long, item_id long"))
    return reduce(DataFrame.unionByName, found).distinct()


class _Index:
    """Passages of a block of items with their keys, sorted, for each table."""

    def __init__(self, ids: np.ndarray, texts: list[str], window: int, tables: int, seed: int):
        raw, hashes, sizes = Words().split(texts)
        self.window, self.seed = window, seed
        self.words, self.hashes = [lower(w) for w in raw], hashes
        starts, text = window_starts(sizes, window)
        self.item = ids[text] if len(text) else np.empty(0, np.int64)
        self.starts, self.tables, self.filters = starts, [], []
        self.mask = max(1 << 22, 1 << (16 * len(starts)).bit_length()) - 1
        for t in range(tables):
            keys = walk_keys(hashes, starts, starts + window, window, t, seed)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))
            seen = np.zeros(self.mask + 1, bool)
            seen[(keys & np.uint64(self.mask)).astype(np.int64)] = True
            self.filters.append(np.packbits(seen))

    def candidates(self, keys: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and passages with an equal key."""
        low = (keys & np.uint64(self.mask)).astype(np.int64)
        some = np.flatnonzero((self.filters[table][low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & 1)
        sorted_keys, order = self.tables[table]
        left, right = (np.searchsorted(sorted_keys, keys[some], side) for side in ("left", "right"))
        n = right - left
        pick = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(some, n), order[pick]


def _close(passage: np.ndarray, here: np.ndarray, max_edit: int) -> np.ndarray:
    """Which pairs are within ``max_edit``. Each edit can spoil one word of the passage, so pairs
    that lack more of its words are out before their distance is worked out."""
    if not max_edit:
        return np.flatnonzero((passage == here).all(1))
    common = np.zeros(len(passage), np.int64)
    for i in range(passage.shape[1]):
        common += (passage[:, i : i + 1] == here[:, max(0, i - max_edit) : i + max_edit + 1]).any(1)
    some = np.flatnonzero(common >= passage.shape[1] - max_edit)
    return some[edit_distances(passage[some], here[some], max_edit) <= max_edit]


def _searcher(index: _Index, max_edit: int):
    w, wide = index.window, np.arange(index.window + max_edit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for whole in batches:
            for s in range(0, whole.num_rows, 512):
                b = whole.slice(s, 512)
                raw, hashes, sizes = words.split(b.column("text").to_pylist())
                starts, text = window_starts(sizes, w - max_edit)
                if not len(starts) or not len(index.starts):
                    continue
                text_ends = np.cumsum(sizes)[text]
                ends = np.minimum(starts + w, text_ends)
                ids = b.column("doc_id").to_numpy(zero_copy_only=False)
                pairs: set[tuple[int, int]] = set()
                for t in range(len(index.tables)):
                    mine, theirs = index.candidates(walk_keys(hashes, starts, ends, w, t, index.seed), t)
                    for x in range(0, len(mine), 65_536):
                        m, q = mine[x : x + 65_536], index.starts[theirs[x : x + 65_536]]
                        place = starts[m][:, None] + wide
                        here = np.where(place < text_ends[m][:, None], hashes[np.minimum(place, len(hashes) - 1)], _END)
                        passage = index.hashes[q[:, None] + wide[:w]]
                        # Candidates that agree in the sampled places only go here.
                        for i in _close(passage, here, max_edit).tolist():
                            pair = (int(ids[text[m[i]]]), int(index.item[theirs[x + i]]))
                            if pair not in pairs:
                                at = starts[m[i]]
                                mine_words = [lower(v) for v in raw[at : min(at + w + max_edit, text_ends[m[i]])]]
                                if _near(index.words[q[i] : q[i] + w], mine_words, max_edit):
                                    pairs.add(pair)
                if pairs:
                    d, i = zip(*sorted(pairs))
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64())], ["doc_id", "item_id"])

    return run


def _near(passage: list[str], words: list[str], max_edit: int) -> bool:
    """The same check on the words themselves, so that no hash has the last word."""
    if passage == words[: len(passage)]:
        return True
    if not max_edit:
        return False
    number = {w: i for i, w in enumerate(dict.fromkeys(passage + words))}
    coded = [number[w] for w in words] + [-1] * (len(passage) + max_edit - len(words))
    return int(edit_distances(np.array([[number[w] for w in passage]]), np.array([coded]), max_edit)[0]) <= max_edit

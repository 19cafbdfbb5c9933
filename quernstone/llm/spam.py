"""Keyword-stuffed and link-list pages, by robust outlier distance of their passages.

A document is cut into passages (lines, and sentences of long lines). Each passage has features of
density, entropy, repetition and function words over a window of neighbouring words, so that a line
of one keyword can be judged too. Per language a robust centre and scatter of the passages of the
corpus are estimated; the Mahalanobis distance to it says how unusual a passage is. Unusual alone is
not spam: tables, code and logs lack function words as well. A passage is flagged if it is far out
and its deviation points in the directions of spam (denser, more repetition, less entropy). A
document is a case if flagged passages hold more than half of its characters.

Features are such that ordinary text has scatter in each, so nothing has to be put in its place:

* repetition and lack of entropy are counts in a window, taken as square roots, which gives counts
  of any size about the same scatter;
* a link, whatever its address, is one word, so a list of links repeats itself; its length, cut at
  ``LONGEST`` letters like that of any word, makes density: the mean length of words. Links and tags
  of compound words are long, text isn't;
* function words are not listed here. They are words that many of a language's texts hold, about as
  often as chance would have it, as words of a subject come in bursts (inverse document frequency
  against a Poisson expectation). Texts without a known language go by the fit of all.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.bounds import checkpoint, spread

FEATURES = ("repetition", "disorder", "function", "density")
# Which way spam deviates, by feature; lacking function words alone is no sign of it.
_SPAM_SIGN = np.array([1.0, 1.0, 0.0, 1.0])
_P = len(FEATURES)

#: Words around a passage that all features but function words are taken over, and words for those.
WINDOW, FUNCTION_WINDOW = 70, 12
#: Letters of a word that count.
LONGEST = 12
#: Letters that say as much as a word: a window of few words and few letters says little.
WORD_LETTERS = 5
#: Function words: in at least this share of a language's texts, where they stand at most so many
#: times as often as words strewn by chance, and at most so many a language.
COMMON, BURST, MOST_COMMON = 0.1, 3.0, 200
#: Languages served: declared for at least this share of the texts, and at most so many.
LEAST_SHARE, MOST_LANGUAGES = 0.005, 24
#: Texts of all languages that are added to those of each: a language of few texts is near the fit of
#: all, one of many has its own.
PRIOR = 10.0

_ANCHOR = re.compile(r"<a\s[^<>]*?href\s*=\s*[\"']?([^\"'<>\s]+)[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!][^<>\n]{0,300}>")
_LINK = re.compile(r"\]\([^)\s]*\)|(?:https?://|www\.)[^\s<>)\"']+", re.I)
_BREAK = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
#: Stands for a link among the words of a text; a character of private use.
_A_LINK = "\ue000"
_WORD = re.compile(r"[\u3400-\u9fff\ue000]|[^\W_\u3400-\u9fff]+")  # Chinese by characters
_CODE = re.compile(r"\s*([a-zA-Z]{2,3})(?![a-zA-Z])")


def passages(text: str) -> list[str]:
    """Lines without markup; lines of several sentences are cut into those."""
    if _A_LINK in text:
        text = text.replace(_A_LINK, " ")
    if "<" in text:
        text = _TAG.sub("\n", _ANCHOR.sub(r" \1 ", text).replace("</a>", " "))
    if "&" in text:
        text = html.unescape(text)
    out = []
    for line in text.splitlines():
        line = line.strip()
        if len(line) > 120:
            out += [x for x in _BREAK.split(line) if x and not x.isspace()]
        elif line:
            out.append(line)
    return out


def code_of(declared: str | None) -> str:
    """The language code at the start of a declared language, or nothing."""
    found = _CODE.match(declared or "")
    return found[1].lower() if found else ""


class Lexicon:
    """Function words of the languages served; ``common`` maps a language to its words."""

    def __init__(self, common: dict[str, list[str]]):
        self.languages = sorted(common)
        self.place = {lang: i for i, lang in enumerate(self.languages)}
        self.bits: dict[str, int] = {}
        for lang, words in common.items():
            for w in words:
                self.bits[w] = self.bits.get(w, 0) | 1 << self.place[lang]


def lexicon_of(given: DataFrame) -> Lexicon:
    """Function words by counts over all texts (columns text, lang). Only words that a tenth of a
    language's texts hold reach the driver: ten times as many as a text has different words at most,
    and no more than ``2 * MOST_COMMON``."""
    counts = given.mapInArrow(_word_counts, "lang string, word string, texts long, times long").groupBy("lang", "word").agg(F.sum("texts").alias("texts"), F.sum("times").alias("times"))
    counts = checkpoint(counts)
    sizes = {r["lang"]: r["texts"] for r in counts.where("word = ''").orderBy(F.desc("texts"), "lang").limit(MOST_LANGUAGES).collect()}
    every = sum(sizes.values())
    sizes = {lang: n for lang, n in sizes.items() if lang and n >= LEAST_SHARE * every}
    if not sizes:
        return Lexicon({})
    least = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, COMMON * n)])[F.col("lang")]
    often = counts.where((F.col("word") != "") & (F.col("texts") >= least))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("texts"), "word"))
    common: dict[str, list[str]] = {lang: [] for lang in sizes}
    for r in often.withColumn("r", rank).where(F.col("r") <= 2 * MOST_COMMON).orderBy("lang", "r").collect():
        n, texts, times = sizes[r["lang"]], r["texts"], r["times"]
        by_chance = -np.log(max(1 - texts / n, 0.5 / n)) / (texts / n)  # mean times in texts that hold it
        if times / texts <= BURST * by_chance and len(common[r["lang"]]) < MOST_COMMON:
            common[r["lang"]].append(r["word"])
    return Lexicon(common)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, times = {}, {}
        for text, declared in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            if text:
                lang = code_of(declared)
                words = _WORD.findall(text.lower())
                if lang not in texts:
                    texts[lang], times[lang] = Counter(), Counter()
                texts[lang].update(set(words))
                texts[lang][""] += 1
                times[lang].update(words)
        for lang, of in texts.items():
            words = [w for w in of if not "0" <= w[:1] <= "9"]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array([of[w] for w in words], pa.int64()), pa.array([times[lang][w] for w in words], pa.int64())], ["lang", "word", "texts", "times"])


@dataclass
class Passages:
    """Passages of a batch of texts."""

    lang: np.ndarray   # of each text: place among the languages, -1 unknown
    text: np.ndarray   # of each passage: place of its text, ascending
    chars: np.ndarray  # without blanks
    sure: np.ndarray   # how far its window has the usual size
    x: np.ndarray      # features


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values)))


class Reader:
    """Turns texts to features; remembers words from batch to batch, up to a bound."""

    def __init__(self, lexicon: Lexicon, remembered: int = 500_000):
        self.lexicon, self.remembered = lexicon, remembered
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = {}
        self.bits, self.digit, self.letters = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def _codes(self, words: list[str]) -> np.ndarray:
        if len(self.code) > self.remembered:
            self._forget()
        new = list(set(words).difference(self.code))
        self.code.update(zip(new, range(len(self.code), len(self.code) + len(new))))
        known = self.lexicon.bits
        self.bits = np.concatenate((self.bits, np.array([known.get(w, 0) for w in new], np.int64)))
        self.digit = np.concatenate((self.digit, np.array(["0" <= w[0] <= "9" for w in new], bool)))
        self.letters = np.concatenate((self.letters, np.array([LONGEST if w == _A_LINK else min(LONGEST, len(w)) for w in new], np.int64)))
        return np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))

    def read(self, texts: list[str | None], declared: list[str | None]) -> Passages:
        text, chars, sizes, words = [], [], [], []
        for i, t in enumerate(texts):
            if not t:
                continue
            linked = "://" in t or "](" in t or "www." in t
            for p in passages(t):
                chars.append(len(p) - p.count(" "))
                p = p.lower()
                if linked:
                    p = _LINK.sub(f" {_A_LINK} ", p)
                w = _WORD.findall(p)
                words += w
                text.append(i)
                sizes.append(len(w))
        text, chars, sizes = (np.array(v, np.int64) for v in (text, chars, sizes))
        codes = self._codes(words)
        passage = np.repeat(np.arange(len(sizes)), sizes)
        lang = self._languages(codes, text[passage], declared)
        if not len(sizes):
            return Passages(lang, text, chars, np.zeros(0), np.zeros((0, _P)))
        of = lang[text[passage]]
        function = (of >= 0) & (self.bits[codes] >> np.maximum(of, 0) & 1 > 0)
        first, last = np.searchsorted(text, text), np.searchsorted(text, text, "right") - 1
        counted = ~self.digit[codes]
        repeats, disorder, density, sure = _around(codes[counted], passage[counted], self.letters[codes], chars, sizes, first, last)
        share = _function_share(function, sizes, first, last)
        # Square roots of counts, and of a share as an angle: their scatter doesn't depend on their size.
        x = np.column_stack((np.sqrt(WINDOW * repeats + 0.375), np.sqrt(WINDOW * disorder + 0.375), np.arcsin(np.sqrt(share)), density))
        return Passages(lang, text, chars, sure, x)

    def _languages(self, codes: np.ndarray, text: np.ndarray, declared: list[str | None]) -> np.ndarray:
        """The declared language, unless the function words of another one are clearly more and make
        up a twelfth of the text; -1 if neither tells."""
        n, many = len(declared), len(self.lexicon.languages)
        said = np.array([self.lexicon.place.get(code_of(d), -1) for d in declared], np.int64)
        if not many:
            return said
        hits = np.stack([np.bincount(text, self.bits[codes] >> i & 1, n) for i in range(many)], 1)
        best, each = hits.argmax(1), np.arange(n)
        most = hits[each, best]
        sure = (most * 12 > np.bincount(text, minlength=n)) & (most > 0)
        close = (said >= 0) & (hits[each, np.maximum(said, 0)] * 1.25 >= most)
        return np.where(sure & ~close, best, said)


def _window(starts: np.ndarray, ends: np.ndarray, size: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words from ``lo`` to ``hi`` around those of each passage, within its text."""
    spare = np.maximum(0, size - (ends - starts))
    return np.maximum(starts[first], starts - spare // 2), np.minimum(ends[last], ends + spare - spare // 2)


def _around(codes: np.ndarray, passage: np.ndarray, letters: np.ndarray, chars: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray):
    """Share of repeats, lack of entropy, log mean length of words, and certainty, by passage."""
    held = np.bincount(passage, minlength=len(sizes))
    ends = np.cumsum(held)
    lo, hi = _window(ends - held, ends, WINDOW, first, last)
    key, back = np.unique(lo * (len(codes) + 1) + hi, return_inverse=True)
    lo, hi = key // (len(codes) + 1), key % (len(codes) + 1)
    n, top = hi - lo, int(codes.max(initial=0)) + 1
    pairs = np.sort(np.repeat(np.arange(len(n)), n) * top + codes[_ranges(lo, hi)])
    edges = np.flatnonzero(np.diff(pairs, prepend=-1))
    counts, window = np.diff(np.append(edges, len(pairs))), pairs[edges] // top
    repeats = np.where(n > 0, 1 - np.bincount(window, minlength=len(n)) / np.maximum(n, 1), 0.0)
    disorder = np.where(n > 1, np.bincount(window, counts * np.log(counts), len(n)) / (np.maximum(n, 2) * np.log(np.maximum(n, 2))), 0.0)
    # Letters of the passages that the window touches.
    if len(codes):
        a, b = passage[np.minimum(lo, len(codes) - 1)], passage[np.maximum(hi - 1, 0)] + 1
    else:
        a, b = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    words, of_words, of_all = _sums(sizes), _sums(letters), _sums(chars)
    density = np.where(n > 0, np.log((np.maximum(0, of_words[words[b]] - of_words[words[a]]) + 1) / np.maximum(1, words[b] - words[a])), 0.0)
    sure = np.where(n > 0, np.minimum(1.0, np.maximum(n, (of_all[b] - of_all[a]) / WORD_LETTERS) / (WINDOW / 2)), 0.0)
    return repeats[back], disorder[back], density[back], sure[back]


def _function_share(function: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    hits, ends = _sums(function), np.cumsum(sizes)
    lo, hi = _window(ends - sizes, ends, FUNCTION_WINDOW, first, last)
    return (hits[hi] - hits[lo]) / np.maximum(1, hi - lo)


# -- the fit -------------------------------------------------------------------------------------

#: Width of a cell in each feature. All features are bounded, so a language has some ten thousand cells
#: at most, however large the corpus; of each the fit gets weight, sums and products.
CELL = np.array([0.4, 0.3, 0.1, 0.05])
_TRI = np.triu_indices(_P)
# Fixed values. Quantiles of chi-square with four degrees of freedom.
CHI_HALF, CHI_75, CHI_975, CHI_999 = 3.357, 5.385, 11.143, 18.467


@dataclass
class Fit:
    centre: np.ndarray
    scatter: np.ndarray
    #: What brings the 0.75 quantile of the corpus' squared distances to that of chi-square.
    scale: float
    #: Texts behind it.
    weight: float


def cells_of(p: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Language and cell, and for each weight, weighted sums and products of the features. A text's
    passages weigh 1 together, so that a page of a thousand links is one text among others."""
    if not len(p.text):
        return np.zeros((0, 1 + _P), np.int64), np.zeros((0, 1 + _P + len(_TRI[0])))
    w = p.sure**2 / np.bincount(p.text)[p.text]
    at = np.clip(np.floor(p.x / CELL), 0, 4095).astype(np.int64)
    packed = p.lang[p.text] + 1
    for c in at.T:
        packed = packed << 12 | c
    packed, back = np.unique(packed, return_inverse=True)
    keys = np.column_stack([(packed >> 12 * _P) - 1, *(packed >> 12 * i & 4095 for i in range(_P - 1, -1, -1))])
    columns = np.column_stack((w, w[:, None] * p.x, w[:, None] * p.x[:, _TRI[0]] * p.x[:, _TRI[1]]))
    sums = np.stack([np.bincount(back, c, len(keys)) for c in columns.T], 1)
    some = sums[:, 0] > 0
    return keys[some], sums[some]


def _moments(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = sums.sum(0)
    centre, second = total[1 : 1 + _P] / total[0], np.zeros((_P, _P))
    second[_TRI] = total[1 + _P :] / total[0]
    second = second + np.triu(second, 1).T - np.outer(centre, centre)
    return centre, second + 1e-9 * np.eye(_P)


def _quantile(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    order = np.argsort(values, kind="stable")
    at = np.cumsum(weights[order])
    return float(values[order][min(len(order) - 1, np.searchsorted(at, q * at[-1]))])


def robust_fit(sums: np.ndarray, rounds: int = 30) -> Fit:
    """Centre and scatter of the half of all weight that lies tightest: concentration steps from
    several starts, the smallest determinant wins. Then reweighted twice by what lies within the
    0.975 quantile. Nothing is added to the scatter but 1e-9 against rounding."""
    w, mean = sums[:, 0], sums[:, 1 : 1 + _P] / sums[:, :1]

    def distances(centre: np.ndarray, scatter: np.ndarray) -> np.ndarray:
        away = mean - centre
        return ((away @ np.linalg.inv(scatter)) * away).sum(1)

    whole = _moments(sums)
    middle = np.array([_quantile(m, w, 0.5) for m in mean.T])
    spread_of = np.array([1.4826 * _quantile(np.abs(m - c), w, 0.5) for m, c in zip(mean.T, middle)])
    starts = [whole, (middle, np.diag(np.where(spread_of > 0, spread_of**2, np.diag(whole[1]))))]
    for m in mean.T:  # the middle half of one feature
        starts.append(_moments(sums[(m >= _quantile(m, w, 0.25)) & (m <= _quantile(m, w, 0.75))]))
    best = None
    for centre, scatter in starts:
        for _ in range(rounds):
            d = distances(centre, scatter)
            before, (centre, scatter) = centre, _moments(sums[d <= _quantile(d, w, 0.5)])
            if np.allclose(before, centre, atol=1e-12):
                break
        size = np.linalg.slogdet(scatter)[1]
        if best is None or size < best[0]:
            best = (size, centre, scatter)
    _, centre, scatter = best
    for _ in range(2):
        d = distances(centre, scatter)
        centre, scatter = _moments(sums[d <= CHI_975 * _quantile(d, w, 0.5) / CHI_HALF])
    return Fit(centre, scatter, _quantile(distances(centre, scatter), w, 0.75) / CHI_75, float(w.sum()))


def fits_of(keys: np.ndarray, sums: np.ndarray, languages: int) -> dict[int, Fit]:
    """A fit for each language, by place, and of all under -1."""
    if not len(keys):
        return {}
    fits = {-1: robust_fit(sums)}
    prior = sums * (PRIOR / sums[:, 0].sum())
    for i in range(languages):
        if (mine := keys[:, 0] == i).any():
            fits[i] = robust_fit(np.concatenate((sums[mine], prior)))
    return fits


def flagged(x: np.ndarray, sure: np.ndarray, fit: Fit, cutoff: float, directed: float) -> np.ndarray:
    """Which passages are far out in a spam-directed way."""
    away = (x - fit.centre) * sure[:, None]
    parts = away * (away @ np.linalg.inv(fit.scatter))  # what each feature adds to the squared distance
    far = cutoff * CHI_999 * fit.scale
    return (parts.sum(1) > far) & (np.where(away * _SPAM_SIGN > 0, parts, 0).sum(1) > directed * far)


_ROW = "doc_id long, lang int, chars array<int>, sure array<float>, features array<float>"
_SUMS = [f"s{i}" for i in range(1 + _P + len(_TRI[0]))]


def spam_shares(documents: DataFrame, *, cutoff: float = 1.0, directed: float = 0.8, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, passages, spam_share of every document: the share of its characters (without
    blanks) in flagged passages. ``lang`` is the language found, null if none.

    A passage is flagged if its squared robust distance exceeds ``cutoff`` times the 0.999 quantile
    of the fitted distances, and what deviations towards spam add to it exceeds ``directed`` of that.
    Distances of passages with little text around them count less. All counts, centres and scatters
    are of all documents: one pass counts words for the lexicon, one makes the features, which are
    written to the checkpoint folder, one brings their sums by cell to the driver for the fit, and
    the last one judges. Every size and language goes the same way.

    Null, empty and blank texts have no passages and share 0. One row out per row in with an id;
    rows with a null id are left out. An empty table gives no rows. Extra columns are not read.
    """
    if cutoff <= 0 or not 0 <= directed <= 1:
        raise ValueError("cutoff is positive, directed lies in [0, 1]")
    given = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("doc_id is not null")
    lexicon = lexicon_of(spread(given.select("text", "lang")))
    rows = checkpoint(spread(given).mapInArrow(_features_of(lexicon), _ROW))
    cells = rows.mapInArrow(_cell_sums, ", ".join(["lang int", *(f"c{i} int" for i in range(_P)), *(f"{s} double" for s in _SUMS)]))
    table = cells.groupBy("lang", *(f"c{i}" for i in range(_P))).agg(*[F.sum(s).alias(s) for s in _SUMS]).orderBy("lang", *(f"c{i}" for i in range(_P))).toArrow()
    keys = np.column_stack([table[c].to_numpy() for c in table.column_names[: 1 + _P]])
    fits = fits_of(keys, np.column_stack([table[s].to_numpy() for s in _SUMS]), len(lexicon.languages))
    return rows.mapInArrow(_share_of(fits, lexicon.languages, cutoff, directed), "doc_id long, lang string, passages int, spam_share double")


def _features_of(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                b = whole.slice(s, 1000)
                p = reader.read(b.column("text").to_pylist(), b.column("lang").to_pylist())
                ends = np.concatenate(([0], np.cumsum(np.bincount(p.text, minlength=b.num_rows)))).astype(np.int32)
                lists = lambda values, wide, kind: pa.ListArray.from_arrays(pa.array(ends * wide), pa.array(values.ravel().astype(kind)))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p.lang.astype(np.int32)), lists(p.chars, 1, np.int32), lists(p.sure, 1, np.float32), lists(p.x, _P, np.float32)], ["doc_id", "lang", "chars", "sure", "features"])

    return run


def _stored(b: pa.RecordBatch) -> Passages:
    chars = b.column("chars")
    sizes = chars.value_lengths().to_numpy(zero_copy_only=False)
    flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False)
    return Passages(b.column("lang").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes), flat("chars"), flat("sure").astype(np.float64), flat("features").reshape(-1, _P).astype(np.float64))


def _cell_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, sums = cells_of(_stored(b))
        yield pa.RecordBatch.from_arrays([*(pa.array(k.astype(np.int32)) for k in keys.T), *map(pa.array, sums.T)], ["lang", *(f"c{i}" for i in range(_P)), *_SUMS])


def _share_of(fits: dict[int, Fit], languages: list[str], cutoff: float, directed: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, n = _stored(b), b.num_rows
            spam = np.zeros(len(p.text), bool)
            of = p.lang[p.text]
            for i in np.unique(of):
                mine = of == i
                if fit := fits.get(int(i), fits.get(-1)):
                    spam[mine] = flagged(p.x[mine], p.sure[mine], fit, cutoff, directed)
            share = np.bincount(p.text[spam], p.chars[spam], n) / np.maximum(np.bincount(p.text, p.chars, n), 1)
            names = pa.array([languages[i] if i >= 0 else None for i in p.lang], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), names, pa.array(np.bincount(p.text, minlength=n).astype(np.int32)), pa.array(share)], ["doc_id", "lang", "passages", "spam_share"])

    return run


def spam_documents(documents: DataFrame, more_than: float = 0.5, **options) -> DataFrame:
    """doc_id of the documents of which more than that share is spam; each once."""
    return spam_shares(documents, **options).where(F.col("spam_share") > more_than).select("doc_id").distinct()

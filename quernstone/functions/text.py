"""Words of a text as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A word is a maximal run of alphabetic or numeric code points.
WORD = r"[\p{IsAlphabetic}\p{N}]+"
# Fixed values. Capital sigma's small form depends on its place when a whole string is
# lower-cased; capital I with dot becomes a letter and a mark, which is no letter. A code point of
# private use stands in for the latter until the words are cut.
_SIGMA, _SMALL_SIGMA, _DOTTED, _SMALL_DOTTED, _STAND_IN = "\u03a3", "\u03c3", "\u0130", "i\u0307", "\ue130"


def words(text: Column) -> Column:
    """Lower-cased words of ``text``; an empty array for null.

    The result is that of cutting first and lower-casing letter by letter, but the text is
    lower-cased as a whole, without a lambda over its words; the two letters for which that would
    differ are replaced before.
    """
    safe = F.lower(F.translate(F.coalesce(text, F.lit("")), _STAND_IN + _SIGMA + _DOTTED, " " + _SMALL_SIGMA + _STAND_IN))
    runs = F.regexp_extract_all(safe, F.lit(WORD.replace("]", _STAND_IN + "]")), F.lit(0))
    back = F.transform(runs, lambda w: F.replace(w, F.lit(_STAND_IN), F.lit(_SMALL_DOTTED)))
    return F.when(F.contains(safe, F.lit(_STAND_IN)), back).otherwise(runs)


def word_count(text: Column) -> Column:
    """How many words ``words`` would give."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def with_positions(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per word: the key columns, ``token`` and its ordinal ``pos`` (from 0)."""
    return df.select(*keys, F.posexplode(words(F.col(text))).alias("pos", "token"))


def term_counts(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """One row per row and distinct word: the key columns, ``dl`` (words in all), ``term``, ``tf``.

    Equal words are brought together by sorting inside the row, so nothing is shuffled and a very
    long text costs n log n. Texts without words give no rows.
    """
    sorted_words = df.select(*keys, F.array_sort(words(F.col(text))).alias("_w"))
    starts = F.filter(F.transform("_w", lambda w, i: F.when((i == 0) | (w != F.get("_w", i - 1)), i)), lambda i: i.isNotNull())
    at = sorted_words.select(*keys, "_w", starts.alias("_s"))
    runs = F.transform("_s", lambda i, n: F.struct(F.get("_w", i).alias("term"), (F.coalesce(F.get("_s", n + 1), F.size("_w")) - i).cast("long").alias("tf")))
    return at.select(*keys, F.size("_w").cast("long").alias("dl"), F.explode(runs).alias("_t")).select(*keys, "dl", "_t.term", "_t.tf")

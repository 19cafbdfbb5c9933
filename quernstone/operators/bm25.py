"""BM25 over live text: postings, corpus statistics, ranked search.

Statistics always describe the rows given: to search a filtered set, filter first. Rows without
text count as documents of length 0.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import term_counts, word_count, words
from .bounds import checkpoint, spread
from .topk import check_k

# Term saturation and length weight of the score.
K1 = 1.2
B = 0.75


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row per document and distinct word: id, term, tf, dl (words of the document).

    Null, empty and wordless texts give no rows. A document is one row; repeated ids are the
    caller's to resolve. Counting happens within the row, so nothing is shuffled per token.
    """
    return term_counts(spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "text", "id").select("id", "term", "tf", "dl")


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n (documents, with or without words) and avgdl (words each, at least 1)."""
    n, dl = F.count("*"), F.sum(word_count(F.col(text_col)))
    return spread(docs.select(text_col)).agg(n.alias("n"), F.greatest(F.coalesce(dl / n, F.lit(1.0)), F.lit(1.0)).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)): above 0 for every df."""
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_score(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column) -> Column:
    """BM25 weight of one term in one document, in double precision."""
    length = F.lit(1.0) - F.lit(B) + F.lit(B) * dl / avgdl
    return idf(n, df) * (tf * F.lit(K1 + 1.0) / (tf + F.lit(K1) * length))


def query_words(spark, query: str) -> Counter:
    """Words of the query with their repeats, cut by the same rule as the documents."""
    return Counter(spark.sql("select 1").select(words(F.lit(query)).alias("w")).first().w)


def text_top_k(docs: DataFrame, query: str, k: int, *, where: Column | None = None, id_col: str = "id", text_col: str = "text",
               seq_col: str | None = "seq", digits: int = 9) -> DataFrame:
    """The ``k`` documents of highest BM25 score above 0: id, score[, seq]; equal score: smaller id.

    A query word counts as often as it is in the query. ``where`` restricts documents before N, df
    and avgdl are taken. An empty query, ``k`` 0 or an empty table gives an empty result.

    One pass over the texts, no shuffle of them: each text is cut if it contains a query word as a
    string and else only counted; ids, lengths and counts of the query's words go to the checkpoint
    folder. N, df, avgdl and the ranking come from there. For many queries over the same rows keep
    the postings and use ``text_top_k_from_postings``.
    """
    check_k(k)
    counts = query_words(docs.sparkSession, query)
    if where is not None:
        docs = docs.where(where)
    keep = [F.col(id_col)] + [F.col(seq_col)] * (seq_col is not None)
    out = [id_col, "score"] + [seq_col] * (seq_col is not None)
    terms = sorted(counts)
    if not terms or not k:
        return docs.select(*keep, F.lit(0.0).alias("score")).select(*out).limit(0)
    small = F.lower(F.translate(F.col(text_col), "\u03a3", "\u03c3"))
    holds = F.coalesce(reduce(Column.__or__, [F.contains(small, F.lit(t)) for t in terms]), F.lit(False))
    cut = spread(docs.select(*keep, text_col)).select(*keep, text_col, F.when(holds, words(F.col(text_col))).alias("_w"))
    tf = [F.coalesce(F.size("_w") - F.size(F.array_remove("_w", t)), F.lit(0)).cast("double").alias(f"_t{i}") for i, t in enumerate(terms)]
    length = F.when(F.col("_w").isNotNull(), F.size("_w")).otherwise(word_count(F.col(text_col))).cast("double").alias("_dl")
    counted = checkpoint(cut.select(*keep, length, *tf))
    stats = counted.agg(F.count("*").cast("double").alias("n"), F.sum("_dl").alias("words"), *[F.sum((F.col(f"_t{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(terms))]).first()
    if not stats["n"]:
        return counted.select(*keep, F.lit(0.0).alias("score")).select(*out)
    n, avgdl = F.lit(stats["n"]), F.lit(max(stats["words"] / stats["n"], 1.0))
    parts = [F.lit(float(counts[t])) * F.when(F.col(f"_t{i}") > 0, term_score(F.col(f"_t{i}"), F.lit(stats[f"df{i}"]), F.col("_dl"), n, avgdl)).otherwise(0.0) for i, t in enumerate(terms)]
    scored = counted.where(" or ".join(f"_t{i} > 0" for i in range(len(terms)))).select(*keep, F.round(reduce(Column.__add__, parts), digits).alias("score"))
    return scored.where("score > 0").select(*out).orderBy(F.desc("score"), id_col).limit(k)


def text_top_k_from_postings(post: DataFrame, stats: DataFrame, query: str, k: int, digits: int = 9) -> DataFrame:
    """The same search over kept postings (id, term, tf, dl) and their ``corpus_stats`` row.

    The query's words, a handful, go to the scan as a pushed-down filter on ``term``.
    """
    check_k(k)
    counts = query_words(post.sparkSession, query)
    some = post.where(F.col("term").isin(sorted(counts)))
    df = some.groupBy("term").agg(F.count("*").alias("df"))  # at most one row per query word
    weight = F.create_map(*[x for t, c in counts.items() for x in (F.lit(t), F.lit(float(c)))]) if counts else F.create_map()
    joined = some.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    d = {c: F.col(c).cast("double") for c in ("tf", "df", "dl", "n", "avgdl")}
    one = joined.select("id", (weight[F.col("term")] * term_score(**d)).alias("s")) if counts else joined.select("id", F.lit(0.0).alias("s"))
    return (one.groupBy("id").agg(F.round(F.sum("s"), digits).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k))

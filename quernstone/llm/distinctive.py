"""How distinctive each word is for its record, by group-bys and joins.

Two weights share the plan. ``ppmi`` is positive pointwise mutual information of term and record,

    max(0, log( p(t, r) / (p(r) * p_a(t)) )),   p_a(t) = cf(t)^a / sum of cf^a,

from joint counts tf(t, r) and the marginals: record lengths and the collection's term counts,
which are the context and are smoothed by the exponent a (0.75), as rare contexts would else win
by chance. ``bm25`` is the search score of the single term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import term_counts, words
from ..operators.bm25 import term_score
from ..operators.bounds import checkpoint

#: Share of all (record, term) rows from which a term counts as hot: at most 1000 terms can be.
HOT_SHARE = 1000
#: Bytes of terms with their counts up to which they are broadcast.
BROADCAST_TERMS = 8 << 20


def term_weights(records: DataFrame, *, weight: str = "ppmi", smoothing: float = 0.75, id_col: str = "external_id", text_col: str = "text") -> DataFrame:
    """external_id, term, tf, weight of every distinct word of every record.

    Null, empty and wordless texts give no rows but count as records. Repeated rows count once:
    rows are reduced to distinct (id, text) first. Of an id with several texts each is weighted as a
    text of its own, and the id is one record. Rows with a null id are left out. An empty table gives
    no rows. Extra columns are not read. Words: runs of letters and digits, lower case.

    Texts are cut once; their counts are written to the checkpoint folder, from which the marginals
    and the weights are taken. A term's count joins back to all its rows, which is where a term that
    half the records hold would make one huge task. Hot terms (over a thousandth of all rows, so at
    most a thousand of them) are joined by broadcast as long as their bytes allow it; the others by a
    shuffle in which none has more than that share.
    """
    if weight not in ("ppmi", "bm25") or not 0 < smoothing <= 1:
        raise ValueError("weight is ppmi or bm25, smoothing lies in (0, 1]")
    given = records.select(F.col(id_col).cast("long").alias("external_id"), F.col(text_col).alias("text")).where("external_id is not null")
    tokens = checkpoint(term_counts(given.distinct(), "text", "external_id"))
    counts = checkpoint(tokens.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")))
    size = F.octet_length("term") + F.lit(48)
    total = counts.agg(F.sum("df").alias("postings"), F.sum("cf").alias("words"), F.sum(F.pow(F.col("cf"), smoothing)).alias("smooth"), F.sum(size).alias("bytes"))
    one = given.agg(F.count_distinct("external_id").cast("double").alias("n")).crossJoin(total).first()  # one row each
    if not one["postings"]:
        return tokens.select("external_id", "term", "tf", F.lit(0.0).alias("weight"))

    if weight == "bm25":
        n, avgdl = one["n"], max(one["words"] / one["n"], 1.0)
        value = term_score(F.col("tf").cast("double"), F.col("df").cast("double"), F.col("dl").cast("double"), F.lit(n), F.lit(float(avgdl)))
    else:
        p_joint, p_record = F.col("tf") / F.lit(float(one["words"])), F.col("dl") / F.lit(float(one["words"]))
        p_term = F.pow(F.col("cf").cast("double"), smoothing) / F.lit(one["smooth"])
        value = F.greatest(F.log(p_joint / (p_record * p_term)), F.lit(0.0))

    def weighted(t: DataFrame, c: DataFrame) -> DataFrame:
        return t.join(c, "term").select("external_id", "term", "tf", value.alias("weight"))

    if one["bytes"] <= BROADCAST_TERMS:
        return weighted(tokens, F.broadcast(counts))
    is_hot = F.col("df") * HOT_SHARE > one["postings"]
    hot = counts.where(is_hot)  # at most HOT_SHARE rows
    if (hot.agg(F.sum(size)).first()[0] or 0) > BROADCAST_TERMS:  # of very long terms
        return weighted(tokens, counts)
    hot = F.broadcast(hot)
    cold = tokens.join(hot.select("term"), "term", "left_anti")
    return weighted(tokens, hot).unionByName(weighted(cold, counts.where(~is_hot)))


def top_terms(weights: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` terms of greatest weight per record (equal weights: smaller term first).

    Spark keeps k rows per record before the shuffle, too.
    """
    order = W.partitionBy("external_id").orderBy(F.desc("weight"), "term")
    return weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


__all__ = ["term_weights", "top_terms", "words"]

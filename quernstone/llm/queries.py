"""Queries of this folder's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .distinctive import term_weights, top_terms
from .encode import encode
from .frequency import term_frequencies
from .leaks import leaked_items
from .neighbours import similar_pairs
from .ranking import best_items, ideal_point
from .spam import spam_documents, spam_shares

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def live_records(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Rows of live records; repeated rows are still there."""
    return table(spark, folder, "records").where("lifecycle = 0").select("external_id", *columns)


@query()
def p1_found(spark, folder):
    return similar_pairs(live_records(spark, folder, "vector"), dim=64)


# -- words -----------------------------------------------------------------------------------

_LIVE = r"""l as (select distinct external_id, text from records where lifecycle = 0),
  w as (select external_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: lower(x))) as term from l),
  t as (select external_id, term, count(*) as tf from w group by all),
  c as (select term, count(*) as df, sum(tf) as cf from t group by all),
  d as (select external_id, sum(tf) as dl from t group by all),
  s as (select (select count(*) from l)::double as n, (select sum(tf) from t)::double as words, (select sum(pow(cf, 0.75)) from c) as smooth)"""


@query(f"""with {_LIVE},
  x as (select external_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * (1.2 + 1.0) / (tf + 1.2 * (1.0 - 0.75 + 0.75 * dl / greatest(words / n, 1.0)))) as weight
        from t join c using (term) join d using (external_id), s)
  select external_id, term from x qualify row_number() over (partition by external_id order by weight desc, term) <= 3""")
def p4_found(spark, folder):
    return top_terms(term_weights(live_records(spark, folder, "text"), weight="bm25"), 3).select("external_id", "term")


@query(f"""with {_LIVE},
  x as (select external_id, term, round(greatest(ln((tf / words) / ((dl / words) * (pow(cf, 0.75) / smooth))), 0.0), 8) as weight
        from t join c using (term) join d using (external_id), s)
  select external_id, term, weight from x qualify row_number() over (partition by external_id order by weight desc, term) <= 3""")
def p4_mutual_information(spark, folder):
    weights = term_weights(live_records(spark, folder, "text"), weight="ppmi").withColumn("weight", F.round("weight", 8))
    return top_terms(weights, 3).select("external_id", "term", "weight")


@query(f"""with {_LIVE} select term, mark from (select term, case when df < 3 then 'rare' when df > n * 0.1 then 'common' end as mark from c, s) where mark is not null""")
def p6_found(spark, folder):
    return term_frequencies(live_records(spark, folder, "text")).where("mark is not null").select("term", "mark")


@query(f"""with {_LIVE} select term, cast(cf as bigint) as occurrences, df as records from c""")
def p6_counts(spark, folder):
    return term_frequencies(live_records(spark, folder, "text")).select("term", "occurrences", "records")


# -- rankings --------------------------------------------------------------------------------

_HITS = "h as (select query_id, path, external_id, max(score) as score from hits where score is not null and not isnan(score) and query_id is not null and path is not null and external_id is not null group by all)"


@query(f"""with {_HITS}, r as (select *, row_number() over (partition by query_id, path order by score desc, external_id) as place from h),
  f as (select query_id, external_id, round(sum(1.0::double / (60 + place)), 9) as s from r group by all)
  select query_id, external_id from f qualify row_number() over (partition by query_id order by s desc, external_id) <= 10""")
def p5_found(spark, folder):
    ranked = ideal_point(table(spark, folder, "hits"), scale="reciprocal_rank", power=1)
    return best_items(ranked, 10, by="to_anti").select("query_id", "external_id")


@query(f"""with {_HITS}, e as (select query_id, path, quantile_disc(score, 0.05) as lo, quantile_disc(score, 0.95) as hi from h group by all),
  c as (select query_id, path, external_id, greatest(least(score, hi), lo) as clip from h join e using (query_id, path)),
  n as (select query_id, path, sqrt(sum(clip * clip)) as norm, min(clip) as lo, max(clip) as hi from c group by all),
  m as (select query_id, path, case when norm > 0 then norm else 1 end as len, lo / len as worst, hi / len as best from n),
  a as (select query_id, sum(pow(best - worst, 2)) as every from m group by all),
  v as (select query_id, external_id, sum(pow(clip / len - worst, 2)) as up, sum(pow(best - worst, 2) - pow(best - clip / len, 2)) as nearer from c join m using (query_id, path) group by all),
  d as (select query_id, external_id, sqrt(up) as ta, sqrt(case when every - nearer > every * 1e-12 then every - nearer else 0 end) as ti from v join a using (query_id)),
  x as (select query_id, external_id, round(case when ta + ti > 0 then ta / (ta + ti) else 0 end, 9) as closeness from d)
  select query_id, external_id, closeness, row_number() over (partition by query_id order by closeness desc, external_id) as rank from x qualify rank <= 10""")
def p5_ideal_point(spark, folder):
    ranked = ideal_point(table(spark, folder, "hits"))
    return best_items(ranked, 10).select("query_id", "external_id", F.round("closeness", 9).alias("closeness"), F.col("rank").cast("long").alias("rank"))


# -- documents -------------------------------------------------------------------------------

@query()
def p7_ids(spark, folder):
    import public_tokenizers

    return encode(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


_W10 = r"list_transform(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: lower(x))"


def _windows_sql(name: str, key: str, source: str) -> str:
    return f"""{name}w as (select {key}, {_W10} as w from {source}), {name} as (select distinct {key}, array_to_string(w[i : i + 9], ' ') as p
      from (select {key}, w, unnest(range(1, len(w) - 8)) as i from {name}w where len(w) >= 10))"""


@query(f"with {_windows_sql('i', 'item_id', 'eval_items')}, {_windows_sql('d', 'doc_id', 'documents')} select distinct doc_id, item_id from d join i using (p)")
def p8_found(spark, folder):
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


@query(f"""with {_windows_sql('i', 'item_id', 'eval_items')}, {_windows_sql('d', 'doc_id', 'documents')}, f as (select distinct doc_id, item_id from d join i using (p))
  select item_id, suite, count(doc_id) as documents from eval_items left join f using (item_id) group by all""")
def p8_items(spark, folder):
    items = table(spark, folder, "eval_items")
    return items.select("item_id", "suite").join(p8_found(spark, folder), "item_id", "left").groupBy("item_id", "suite").agg(F.count("doc_id").alias("documents"))


@query()
def p8_near(spark, folder):
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items"), max_edit=1)


@query()
def p9_found(spark, folder):
    return spam_documents(table(spark, folder, "documents"))


@query()
def p9_shares(spark, folder):
    shares = spam_shares(table(spark, folder, "documents"))
    return shares.select("doc_id", F.round("spam_share", 6).alias("spam_share"))

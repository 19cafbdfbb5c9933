"""Queries over the test tables for the core operators, and their SQL.

Each takes a session and a folder of Parquet tables and returns a DataFrame. Mapping used:
``embeddings`` (vec_id, embedding) are the vectors, ``documents`` the texts, ``records`` and
``segment_entries`` the versioned rows, ``events`` a second change log (key user_id, number
event_id; an error event deletes).
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .api import connect
from .errors import SchemaError, StorageError, TransactionError
from .functions import text as text_fn, vector as vec
from .operators import ann, bm25, changes, fusion, incremental, liveview, timing, topk
from .operators.bounds import scratch_folder
from .plans import Compare, Eq, FaithfulMeta, Fields, In, NotPresent, Present, Range, filter_column, parse_where, value_column
from .plans.predicate import coerce_where
from .sources import synth
from .streaming import stream_into

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Query texts of the text searches.
TEXT = "vector index store"
TEXT_REPEATED = "store store index"


def query(sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") + 1).alias("seq"), F.col("embedding").alias("vector"), "label")


def _first_vector(vectors: DataFrame) -> list[float]:
    return vectors.where("id = 0").select("vector").first()[0]


# -- vectors ---------------------------------------------------------------------------------

_Q = "q as (select embedding as qv from embeddings where vec_id = 0)"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double))"
_NORM = "sqrt(list_sum(list_transform({a}, lambda x: x::double * x::double)))"
_L2 = "0.0::double - list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1]::double - p[2]::double) * (p[1]::double - p[2]::double)))"


def _top_sql(score: str, where: str = "true") -> str:
    return f"with {_Q} select vec_id as id, round({score}, 9) as score, vec_id + 1 as seq from embeddings, q where {where} order by score desc, id limit 10"


_V = {"a": "embedding", "b": "qv"}
_P = {"a": "embedding[1:16]", "b": "qv[1:16]"}
_COS = "{d} / ({n} * {m})".format(d=_DOT.format(**_V), n=_NORM.format(a="embedding"), m=_NORM.format(a="qv"))


def _top(spark, folder, metric, n=None, where=None):
    v = _vectors(spark, folder)
    q = _first_vector(v)[:n]
    return topk.exact_top_k(v, q, 10, metric, where=where, digits=9)


@query(_top_sql(_DOT.format(**_V)))
def vec_topk_dot(spark, folder):
    return _top(spark, folder, "dot")


@query(_top_sql(_COS))
def vec_topk_cosine(spark, folder):
    return _top(spark, folder, "cosine")


@query(_top_sql(_L2.format(**_V)))
def vec_topk_l2(spark, folder):
    return _top(spark, folder, "l2")


@query(_top_sql(_L2.format(**_P)))
def vec_topk_prefix16(spark, folder):
    return _top(spark, folder, "l2", 16)


@query(_top_sql(_DOT.format(**_V), "label = 3"))
def vec_topk_filtered_label(spark, folder):
    v = _vectors(spark, folder)
    return _top(spark, folder, "dot", where=filter_column(Eq("label", 3), Fields.of(v)))


@query(_top_sql(_L2.format(**_V), "label <> 3 and label <= 6"))
def vec_topk_where_string(spark, folder):
    v = _vectors(spark, folder)
    return _top(spark, folder, "l2", where=filter_column(parse_where("label != 3 AND NOT (label > 6)"), Fields.of(v)))


@query(f"select vec_id as id, round({_NORM.format(a='embedding')}, 9) as norm from embeddings")
def vec_norms(spark, folder):
    return _vectors(spark, folder).select("id", F.round(vec.norm(F.col("vector")), 9).alias("norm"))


@query(f"""with s as (select a.vec_id as qid, b.vec_id as id, round({_DOT.format(a='a.embedding', b='b.embedding')}, 9) as score
    from embeddings a, embeddings b where a.vec_id % 100 = 0),
  r as (select *, row_number() over (partition by qid order by score desc, id) as rank from s)
  select qid, cast(rank as bigint) as rank, id, score from r where rank <= 10""")
def vec_topk_batch(spark, folder):
    v = _vectors(spark, folder)
    queries = v.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))
    return topk.batch_top_k(v, queries, 10, "dot", dim=64)


@query(f"""with s as (select a.vec_id as qid, b.vec_id as id, round({_L2.format(a='a.embedding', b='b.embedding')}, 9) as score from embeddings a, embeddings b where a.vec_id % 100 = 0),
  t as (select qid, id, row_number() over (partition by qid order by score desc, id) as rank from s qualify rank <= 10),
  p as (select qid, count(*) filter (rank > qid // 100 % 4 and qid <> 100)::double / 10 as recall from t group by qid)
  select count(*) as queries, cast(10 as bigint) as k, round(avg(recall), 9) as mean_recall, round(min(recall), 9) as min_recall, avg(recall) >= 0.998 as passed from p""")
def recall_of_damaged_ranking(spark, folder):
    """Query q lost its first q / 100 mod 4 hits, query 100 all of them; false hits came instead."""
    v = _vectors(spark, folder)
    queries = v.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))
    truth = topk.batch_top_k(v, queries, 10, "l2", dim=64, query_bytes=8 * 64 * 4)
    kept = truth.where("rank > cast(qid / 100 as bigint) % 4 and qid <> 100").select("qid", "id")
    false = truth.select("qid", (F.col("id") + 1_000_000).alias("id"))
    r = topk.recall_at_k(kept.unionByName(false), truth, 10)
    return r.withColumns({c: F.round(c, 9) for c in ("mean_recall", "min_recall")})


@query(_top_sql(_COS).replace("limit 10", "limit 100000"))
def vec_topk_beyond_table(spark, folder):
    v = _vectors(spark, folder)
    none = topk.exact_top_k(v, _first_vector(v), 0, "cosine", digits=9)
    return none.unionByName(topk.exact_top_k(v, _first_vector(v), 100_000, "cosine", digits=9))


@query()
def ann_topk(spark, folder):
    """Index over all vectors, ten nearest of vector 0 by cosine; no SQL, as it is approximate."""
    v = _vectors(spark, folder)
    index = ann.IvfIndex.build(v, scratch_folder(spark, "index"), "cosine", 64)
    nothing = v.select("id", "seq", "vector", F.lit("upsert").alias("op")).limit(0)
    return ann.indexed_search(index, nothing, _first_vector(v), 10, "cosine")


@query("select count(*) as queries, true as at_least_09 from embeddings where vec_id % 100 = 0")
def ann_recall(spark, folder):
    """Recall of the index for every query id divisible by 100, against the exact ranking."""
    v = _vectors(spark, folder)
    index = ann.IvfIndex.build(v, scratch_folder(spark, "index"), "l2", 64)
    queries = v.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))
    recall = topk.recall_at_k(index.batch_search(queries, 10), topk.batch_top_k(v, queries, 10, "l2", dim=64), 10)
    return recall.select("queries", (F.col("mean_recall") >= 0.9).alias("at_least_09"))


@query(f"""with s as (select a.vec_id as qid, b.vec_id as id, round({_L2.format(a='a.embedding', b='b.embedding')}, 9) as score from embeddings a, embeddings b where a.vec_id % 100 = 0)
  select qid, cast(row_number() over (partition by qid order by score desc, id) as bigint) as rank, id, score from s qualify rank <= 10""")
def ann_all_lists(spark, folder):
    """Reading every list makes the index exact; queries are joined with their lists."""
    v = _vectors(spark, folder)
    index = ann.IvfIndex.build(v, scratch_folder(spark, "index"), "l2", 64)
    queries = v.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("qvector"))
    return index.batch_search(queries, 10, probes=len(index.centres), query_bytes=8 * 64)


@query(f"""with {_Q}, e as (select vec_id as id, case when vec_id % 10 = 1 then list_transform(embedding, lambda x: (0.0 - x)::float) else embedding end as v,
    case when vec_id % 10 = 1 then vec_id + 100001 else vec_id + 1 end as seq from embeddings where vec_id % 7 <> 3 or vec_id % 10 = 1)
  select id, round({_L2.format(a='v', b='qv')}, 9) as score, seq from e, q order by score desc, id limit 20""")
def ann_search_with_tail(spark, folder):
    """Sealed vectors of which newer changes delete some and turn others around; all lists are read."""
    v = _vectors(spark, folder)
    index = ann.IvfIndex.build(v, scratch_folder(spark, "index"), "l2", 64)
    turned = v.where("id % 10 = 1").select("id", (F.col("seq") + 100_000).alias("seq"), F.transform("vector", lambda x: (-x).cast("float")).alias("vector"), F.lit("upsert").alias("op"))
    gone = v.where("id % 7 = 3 and id % 10 <> 1").select("id", (F.col("seq") + 100_000).alias("seq"), F.lit(None).cast("array<float>").alias("vector"), F.lit("delete").alias("op"))
    found = ann.indexed_search(index, turned.unionByName(gone), _first_vector(v), 20, "l2", probes=len(index.centres))
    return found.withColumn("score", F.round("score", 9))


# -- filters ---------------------------------------------------------------------------------

def _records(spark, folder):
    return table(spark, folder, "records").select(F.col("external_id").alias("id"), "seq", "lifecycle", F.col("meta_lang").alias("lang"), F.col("meta_year").alias("year"),
                                                  F.col("meta_score").alias("score"), F.col("meta_ok").alias("ok"))


def _matching(spark, folder, node):
    r = _records(spark, folder)
    return r.where(filter_column(node, Fields.of(r, "seq", "lifecycle"))).select("id", "seq")


def _records_sql(where: str) -> str:
    return f"select external_id as id, seq from records where {where}"


@query(_records_sql("(meta_lang = 'de' or meta_lang in ('fr', 'es')) and not coalesce(meta_ok, false)"))
def where_or_not_in(spark, folder):
    return _matching(spark, folder, parse_where("(lang = 'de' OR lang IN ('fr', 'es')) AND NOT ok = true"))


@query(_records_sql("meta_score > 5 and not isnan(meta_score) and meta_year < 2020"))
def where_range_strict(spark, folder):
    return _matching(spark, folder, parse_where("score > 5 AND year < 2020"))


@query(_records_sql("meta_year between 2012 and 2020"))
def where_range_inclusive(spark, folder):
    return _matching(spark, folder, Range("year", 2012, 2020))


@query(_records_sql("meta_score between 0.5 and 7.25 and not isnan(meta_score)"))
def where_float_range(spark, folder):
    return _matching(spark, folder, Range("score", 0.5, 7.25))


@query(_records_sql("meta_lang is distinct from 'en'"))
def where_missing_neq(spark, folder):
    return _matching(spark, folder, parse_where("lang != 'en'"))


@query(_records_sql("meta_year is null and meta_ok is not null"))
def where_is_null(spark, folder):
    return _matching(spark, folder, NotPresent("year") & Present("ok"))


@query(_records_sql("meta_year is null or meta_year <> 2015"))
def where_not_equal_of_absent(spark, folder):
    return _matching(spark, folder, parse_where("NOT (year = 2015)"))


@query(_records_sql("meta_year = 2016 or meta_ok"))
def where_type_sensitive(spark, folder):
    """Values only match fields of their own type."""
    return _matching(spark, folder, Eq("year", 2015.0) | Eq("year", 2016) | In("ok", (1, True, "true")) | Compare("lang", ">", 3))


@query(_records_sql("meta_lang = 'de' and meta_ok"))
def where_dict(spark, folder):
    return _matching(spark, folder, coerce_where({"lang": "de", "ok": True}))


@query(_records_sql("meta_lang in ('en', 'fr') and meta_year between 2012 and 2018 and meta_score is not null"))
def where_list(spark, folder):
    return _matching(spark, folder, coerce_where([{"in": {"field": "lang", "values": ["en", "fr", 5]}}, {"range": {"field": "year", "lo": 2012, "hi": 2018}}, {"present": "score"}]))


@query(_records_sql("true"))
def where_nothing(spark, folder):
    return _matching(spark, folder, coerce_where(None))


@query("""select external_id as id, coalesce(meta_year >= 2015, false) or not coalesce(meta_score <= 3.5 and not isnan(meta_score), false) as verdict from records""")
def where_value_column(spark, folder):
    r = _records(spark, folder)
    return r.select("id", value_column(parse_where("year >= 2015 OR NOT score <= 3.5"), Fields.of(r)).alias("verdict"))


@query(_records_sql("(meta_lang = 'de' or meta_year >= 2015) and meta_ok is not null"))
def where_tagged_metadata(spark, folder):
    """The same filters where all metadata sits in one array of tagged entries."""
    def entry(key, column, slot):
        cells = [(F.col(column) if slot == k else F.lit(None)).cast(t).alias(k) for k, t in (("i", "long"), ("f", "double"), ("b", "boolean"), ("s", "string"), ("y", "binary"))]
        return F.when(F.col(column).isNotNull(), F.struct(F.lit(key).alias("k"), *cells))

    r = _records(spark, folder)
    tagged = F.array(entry("lang", "lang", "s"), entry("year", "year", "i"), entry("score", "score", "f"), entry("ok", "ok", "b"))
    rows = r.select("id", "seq", F.filter(tagged, lambda e: e.isNotNull()).alias("meta"))
    return rows.where(filter_column(parse_where("(lang = 'de' OR year >= 2015) AND ok IS NOT NULL"), FaithfulMeta())).select("id", "seq")


# -- text ------------------------------------------------------------------------------------

_WORDS = r"list_transform(regexp_extract_all(coalesce({t}, ''), '[\p{{L}}\p{{N}}]+'), lambda w: lower(w))"


def _docs(spark, folder):
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") + 1).alias("seq"), "text", "lang")


def _bm25_sql(words: dict[str, int], where: str = "true", text: str = "text") -> str:
    w = _WORDS.format(t=text)
    values = ", ".join(f"('{t}', {c}.0::double)" for t, c in sorted(words.items()))
    return f"""with d as (select doc_id as id, {w} as w from documents where {where}),
      s as (select count(*)::double as n, greatest(coalesce(sum(len(w))::double / count(*), 1.0), 1.0) as avgdl from d),
      q as (select * from (values {values}) v(term, qtf)),
      p as (select d.id, q.term, q.qtf, len(d.w)::double as dl, len(list_filter(d.w, lambda x: x = q.term))::double as tf from d, q),
      df as (select term, count(*)::double as df from p where tf > 0 group by term),
      x as (select p.id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))) as score
            from p join df using (term), s where tf > 0 group by p.id)
      select id, round(score, 9) as score, id + 1 as seq from x order by score desc, id limit 10"""


@query(f"""with w as (select doc_id as id, unnest({_WORDS.format(t='text')}) as term from documents)
  select id, term, count(*) as tf from w group by all""")
def tokenize_counts(spark, folder):
    return bm25.postings(_docs(spark, folder)).select("id", "term", "tf")


@query(f"""with w as (select doc_id as id, {_WORDS.format(t='text')} as w from documents)
  select id, unnest(w) as token, cast(generate_subscripts(w, 1) - 1 as bigint) as pos from w""")
def tokenize_positions(spark, folder):
    return text_fn.with_positions(_docs(spark, folder), "text", "id").select("id", "token", F.col("pos").cast("long").alias("pos"))


@query(f"select count(*) as n, round(greatest(sum(len({_WORDS.format(t='text')}))::double / count(*), 1.0), 9) as avgdl from documents")
def corpus_stats(spark, folder):
    return bm25.corpus_stats(_docs(spark, folder)).select("n", F.round("avgdl", 9).alias("avgdl"))


@query(_bm25_sql({"vector": 1, "index": 1, "store": 1}))
def bm25_topk(spark, folder):
    return bm25.text_top_k(_docs(spark, folder), TEXT, 10)


@query(_bm25_sql({"vector": 1, "index": 1, "store": 1}, "lang = 'de'"))
def bm25_topk_filtered_lang(spark, folder):
    d = _docs(spark, folder)
    return bm25.text_top_k(d, TEXT, 10, where=filter_column(Eq("lang", "de"), Fields.of(d)))


@query(_bm25_sql({"vector": 1, "index": 1, "store": 1}, text="case when lang = 'es' then null else text end"))
def bm25_null_text(spark, folder):
    d = _docs(spark, folder).withColumn("text", F.when(F.coalesce(F.col("lang") != "es", F.lit(True)), F.col("text")))
    return bm25.text_top_k(d, TEXT, 10)


@query(_bm25_sql({"store": 2, "index": 1}))
def bm25_repeated_query_terms(spark, folder):
    return bm25.text_top_k(_docs(spark, folder), TEXT_REPEATED, 10)


@query(_bm25_sql({"vector": 1, "index": 1, "store": 1}).replace(", id + 1 as seq", ""))
def bm25_from_postings(spark, folder):
    d = _docs(spark, folder)
    return bm25.text_top_k_from_postings(bm25.postings(d), bm25.corpus_stats(d), TEXT, 10)


# -- fusion ----------------------------------------------------------------------------------

def _hybrid_sql(where: str) -> str:
    text = _bm25_sql({"vector": 1, "index": 1, "store": 1}, where).replace("limit 10", "limit 50").removeprefix("with ")
    ctes, last = text.rsplit("select id, round", 1)
    return f"""with {ctes}, tx as (select id, round{last}),
      qq as (select embedding as qv from embeddings where vec_id = 0),
      vx as (select vec_id as id, round({_DOT.format(**_V)}, 9) as score, vec_id + 1 as seq from embeddings, qq
             where vec_id in (select doc_id from documents where {where}) order by score desc, id limit 50),
      u as (select id, seq, row_number() over (order by score desc, id) as rank from tx union all select id, seq, row_number() over (order by score desc, id) from vx)
      select id, round(sum(1.0::double / (60 + rank)), 12) as score, min(seq) as seq from u group by id order by score desc, id limit 10"""


def _hybrid(spark, folder, filtered):
    v, d = _vectors(spark, folder), _docs(spark, folder)
    if filtered:
        d = d.where(filter_column(Eq("lang", "en"), Fields.of(d)))
    q = _first_vector(v)
    in_docs = v.join(d.select("id"), "id", "left_semi")
    return fusion.rrf([topk.exact_top_k(in_docs, q, 50, "dot", digits=9), bm25.text_top_k(d, TEXT, 50)], 10)


@query(_hybrid_sql("true"))
def rrf_hybrid(spark, folder):
    return _hybrid(spark, folder, False)


@query(_hybrid_sql("lang = 'en'"))
def rrf_hybrid_filtered(spark, folder):
    return _hybrid(spark, folder, True)


@query("""with h as (select query_id, path, external_id, max(score) as score from hits where not isnan(score) and query_id is not null and path is not null and external_id is not null group by all),
  r as (select *, row_number() over (partition by query_id, path order by score desc, external_id) as place from h),
  f as (select query_id, external_id, round(sum(1.0::double / (60 + place)), 9) as score from r group by all)
  select query_id, external_id, score, cast(row_number() over (partition by query_id order by score desc, external_id) as bigint) as rank from f qualify rank <= 25""")
def rrf_by_key(spark, folder):
    return fusion.rrf_by_key(table(spark, folder, "hits"), 25)


# -- live view and change feeds ----------------------------------------------------------------

_LATEST = "(select *, row_number() over (partition by user_id order by event_id desc) as rn from events)"
_LIVE_SQL = f"select user_id, event_id, event_type, value from {_LATEST} where rn = 1 and event_type <> 'error'"


def _events(spark, folder):
    return table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")


def _live(spark, folder):
    return liveview.live_view(_events(spark, folder), "user_id", "event_id", F.col("event_type") != "error")


@query(_LIVE_SQL)
def live_view_latest(spark, folder):
    return _live(spark, folder)


@query(f"select count(*) as n from ({_LIVE_SQL})")
def live_count(spark, folder):
    return _live(spark, folder).agg(F.count("*").alias("n"))


@query(f"select * from ({_LIVE_SQL}) where user_id = 7")
def point_get(spark, folder):
    return liveview.point_get(_live(spark, folder), "user_id", 7)


@query(f"""with a(pos, user_id) as (values (0::bigint, 3::bigint), (1, 999999), (2, 7), (3, 3))
  select a.pos, a.user_id, l.event_id, l.event_type, l.value from a left join ({_LIVE_SQL}) l using (user_id)""")
def batch_get(spark, folder):
    return liveview.batch_get(_live(spark, folder), "user_id", [3, 999999, 7, 3])


@query(f"select distinct user_id from events where event_type = 'click' and user_id not in (select user_id from ({_LIVE_SQL}))")
def delete_unknown_check(spark, folder):
    return liveview.unknown_keys(_events(spark, folder).where("event_type = 'click'"), _live(spark, folder), "user_id")


@query("""select r.external_id, r.seq from records r where not exists (select 1 from segment_entries s where s.external_id = r.external_id and s.commit_seq is not null)""")
def l0_shadow_antijoin(spark, folder):
    newer = table(spark, folder, "segment_entries").where("commit_seq is not null")
    return liveview.shadowed(table(spark, folder, "records").select("external_id", "seq"), newer, "external_id")


@query("""select vec_id as id, case when vec_id % 5 = 0 then 'second' else 'first' end as text from embeddings where vec_id % 7 <> 0""")
def store_after_checkpoint(spark, folder):
    """A durable collection: added, deleted, replaced, compacted, and opened again."""
    v, at = _vectors(spark, folder).select("id", "vector"), scratch_folder(spark, "collection")
    c = connect(spark, at, metric="l2")
    c.add_frame(v.withColumn("text", F.lit("first")))
    c.store.delete(v.where("id % 7 = 0").select("id"))
    c.commit()
    c.checkpoint(index=False)
    c.add_frame(v.where("id % 5 = 0 and id % 7 <> 0").withColumn("text", F.lit("second")))
    return connect(spark, at).frame().select("id", "text")


def _store(spark, folder):
    """A collection with all vectors, committed."""
    v, at = _vectors(spark, folder).select("id", "vector"), scratch_folder(spark, "collection")
    c = connect(spark, at, metric="l2")
    c.add_frame(v.orderBy("id").coalesce(1).withColumn("text", F.lit("first")))
    return c, v, at


@query("select vec_id as id, row_number() over (order by vec_id) as seq from embeddings")
def store_scan(spark, folder):
    """Records in the order of their changes."""
    return _store(spark, folder)[0].scan().select("id", "seq")


@query("""select vec_id as id, case when vec_id = 3 then 'third' when vec_id in (5, 6) then 'kept' else 'first' end as text from embeddings where vec_id not in (0, 7, 14)
  union all select 1000001, 'new'""")
def store_transactions(spark, folder):
    """A transaction that fails, one that holds, a rollback, single and batch writes; read by another handle."""
    c, v, at = _store(spark, folder)
    try:
        with c.transaction():
            c.delete([1, 2])
            c.upsert(4, [0.0] * 64, "lost")
            raise KeyError("the caller's error")
    except KeyError:
        pass
    with c.transaction():
        c.delete([0, 7, 14])
        c.upsert(3, [1.0] * 64, "third")
        c.upsert(1_000_001, [2.0] * 64, "new")
    c.autocommit = False
    c.add([8, 9], [[0.0] * 64] * 2, ["lost", "lost"])
    c.rollback()
    c.add([5, 6], [[0.0] * 64] * 2, ["kept", "kept"])
    c.commit()
    c.delete(10)  # never committed
    return connect(spark, at).frame().select("id", "text")


@query("""select 'before' as view, count(*) as n, sum(vec_id)::bigint as ids from embeddings union all
  select 'during', count(*), sum(vec_id)::bigint from embeddings union all
  select 'after', count(*), sum(vec_id)::bigint from embeddings where vec_id % 3 <> 0""")
def store_reader_during_write(spark, folder):
    """Readers of a store before, during and after a transaction and two checkpoints of its writer."""
    c, v, at = _store(spark, folder)
    c.checkpoint(index=False)
    before = connect(spark, at).frame()
    with c.transaction():
        c.store.delete(v.where("id % 3 = 0").select("id"))
        during = connect(spark, at).frame()
    c.checkpoint(index=False, prune_log=True)
    c.checkpoint(index=False)
    after = connect(spark, at).frame()
    views = [f.agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(name).alias("view"), "n", "ids") for name, f in (("before", before), ("during", during), ("after", after))]
    return views[0].unionByName(views[1]).unionByName(views[2])


@query("select vec_id as id, case when vec_id % 4 = 1 then 'second' else 'first' end as text from embeddings where vec_id % 4 <> 0")
def store_without_snapshot(spark, folder):
    """The snapshot is lost: everything comes from the log again."""
    c, v, at = _store(spark, folder)
    c.store.delete(v.where("id % 4 = 0").select("id"))
    c.commit()
    c.checkpoint(index=False)
    c.add_frame(v.where("id % 4 = 1").withColumn("text", F.lit("second")))
    c.store.files.remove(f"{at}/snapshots")
    return connect(spark, at).frame().select("id", "text")


@query("""select a.pos::bigint as pos, e.vec_id as id, case when e.vec_id is not null then 'first' end as text
  from (values (0, 5), (1, 999999), (2, 0), (3, 5)) a(pos, id) left join embeddings e on e.vec_id = a.id""")
def store_lookup(spark, folder):
    """Several ids in the order asked, as the Python surface returns them."""
    found = _store(spark, folder)[0].get([5, 999_999, 0, 5])
    return spark.createDataFrame([(i, r and r["external_id"], r and r["text"]) for i, r in enumerate(found)], "pos long, id long, text string")


def _refused(call) -> bool:
    try:
        call()
    except (SchemaError, StorageError, TransactionError):
        return True
    return False


_REFUSALS = ("other metric", "other safety", "empty batch", "lengths differ", "wrong dimension", "non-finite vector", "negative id", "mixed ids", "unknown delete", "empty delete", "nested transaction", "checkpoint in a transaction",
             "query too long", "query not finite", "empty query", "zero cosine query", "negative k", "pool below k", "no hybrid query", "dot index", "NaN bound", "half a where", "unknown metric")


@query("select case_name, refused from (values " + ", ".join(f"('{r}', true)" for r in _REFUSALS) + ", ('same metric', false), ('repeated id', false)) t(case_name, refused)")
def store_refusals(spark, folder):
    """What must be refused loudly, and what must not; nothing refused leaves a trace."""
    c, v, at = _store(spark, folder)
    n, nan, z = 64, float("nan"), [0.0] * 64

    def nested():
        with c.transaction():
            with c.transaction():
                pass

    def inside():
        with c.transaction():
            c.checkpoint()

    calls = (lambda: c.set_metric("dot"), lambda: connect(spark, at, safety="normal"), lambda: c.add([], []), lambda: c.add([1, 2], [z]), lambda: c.add([1], [[1.0]]), lambda: c.add([1], [[nan] * n]), lambda: c.add([-1], [z]),
             lambda: c.add([1, "a"], [z, z]), lambda: c.delete([1, 777_777]), lambda: c.delete([]), nested, inside, lambda: c.search([0.0] * 65, 3), lambda: c.search([nan] * n, 3), lambda: c.search([], 3),
             lambda: c.search(z, 3, metric="cosine"), lambda: c.search(z, -1), lambda: c.search(z, 5, pool=2), lambda: c.hybrid_search(3), lambda: ann.IvfIndex.build(v, at, "dot", n),
             lambda: filter_column(Range("x", nan, 1), Fields.of(v)), lambda: parse_where("id ="), lambda: connect(spark, at, metric="manhattan"))
    rows = [(name, _refused(call)) for name, call in zip(_REFUSALS, calls)]
    rows += [("same metric", _refused(lambda: c.set_metric("l2"))), ("repeated id", _refused(lambda: c.add([1, 1], [z, z])))]
    return spark.createDataFrame(rows, "case_name string, refused boolean")


@query(f"select user_id as id, event_type as text from ({_LIVE_SQL})")
def stream_into_store(spark, folder):
    """The change log as a stream, applied to a store by micro-batches in the order of its numbers."""
    at = scratch_folder(spark, "stream")
    c = connect(spark, f"{at}/c", metric="l2")
    kinds = {"norm": "float", "meta": c.store.settings.row_type().split("meta ", 1)[1]}
    rows = _events(spark, folder).select(F.col("user_id").alias("id"), F.array(F.coalesce(F.col("value"), F.lit(0.0)).cast("float")).alias("vector"), *[F.lit(None).cast(t).alias(k) for k, t in kinds.items()],
                                         F.col("event_type").alias("text"), F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("event_id").alias("ord"))
    middle = (rows.agg(F.max("ord")).first()[0] or 0) * 3 // 5
    for half in (rows.where(F.col("ord") < middle), rows.where(F.col("ord") >= middle)):
        half.coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream_into(c.store, spark.readStream.schema(rows.schema).parquet(f"{at}/in"), f"{at}/progress").awaitTermination()
    return connect(spark, f"{at}/c").frame().select("id", "text")


@query("select cast(vec_id + 1 as bigint) as id, round(embedding[1]::double, 9) as first, round(embedding[64]::double, 9) as last, 3 as queries from embeddings")
def sift_file(spark, folder):
    """A benchmark file of 128-dimensional vectors, written from the vectors twice over and loaded."""
    v = _vectors(spark, folder).orderBy("id").select("vector").toArrow()["vector"]  # the loader is for files that one machine holds
    x, _ = topk.batch_matrix(v, 64, "float32")
    with tempfile.NamedTemporaryFile(suffix=".bin") as f:
        synth.write_sift(f.name, [[*row, *row] for row in x.tolist()], [[*row, *row] for row in x[:3].tolist()])
        rows, queries = synth.read_sift(spark, f.name)
    return rows.select("id", F.round(F.get("vector", F.lit(0)).cast("double"), 9).alias("first"), F.round(F.get("vector", F.lit(127)).cast("double"), 9).alias("last"), F.lit(len(queries)).alias("queries"))


@query("""select 'uniform' as kind, 2000::bigint as n, 2001000::bigint as ids, true as in_range, true as again union all select 'clustered', 2000, 2001000, true, true union all select 'queries', 50, 1275, true, true""")
def generators(spark, folder):
    """Ids, value ranges and repeatability of the generators."""
    def row(kind, df, sound):
        return df().agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.min(sound).alias("in_range")).select(F.lit(kind).alias("kind"), "n", "ids", "in_range", F.lit(df().exceptAll(df()).isEmpty()).alias("again"))

    every = lambda low, high: (F.array_min("vector") >= low) & (F.array_max("vector") < high) & (F.size("vector") == 8)
    asked = lambda: spark.createDataFrame(list(enumerate(synth.clustered_queries(50, 8, 5), 1)), "id long, vector array<double>")
    return row("uniform", lambda: synth.uniform(spark, 2000, 8), every(0, 1)).unionByName(row("clustered", lambda: synth.clustered(spark, 2000, 8, 5), every(-0.5, 1.5))).unionByName(row("queries", asked, every(-1, 2)))


@query("select event_type, count(*) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events where value is not null and not isnan(value) group by event_type")
def timing_percentiles(spark, folder):
    t = timing.timing_summary(table(spark, folder, "events"), "value", "event_type")
    return t.withColumns({c: F.round(c, 6) for c in ("mean", "p50", "p95", "p99")})


_ENTRIES = """e as (select seq, external_id, min(lifecycle) as lifecycle, bool_or(commit_seq is not null) as acked from segment_entries group by 1, 2),
  a as (select external_id, seq, lifecycle from records union all select external_id, seq, lifecycle from e where acked)"""


@query(f"""with {_ENTRIES}, m as (select external_id, max(seq) as seq from a where lifecycle in (0, 1) group by 1)
  select distinct m.external_id, m.seq from m join a using (external_id, seq) where a.lifecycle = 0""")
def p2_found(spark, folder):
    every = changes.acknowledged_changes(table(spark, folder, "records"), table(spark, folder, "segment_entries"))
    files = changes.ChangeFiles(spark, scratch_folder(spark, "changes"), "external_id", "seq")
    files.append(every, is_insert=F.col("lifecycle") == 0, is_delete=F.col("lifecycle") == 1)
    return files.read()


@query("""with m as (select checkpoint_seq, segments from manifests where status = 'published' order by generation desc limit 1),
  e as (select s.seq, s.external_id, bool_or(s.commit_seq is not null) as acked, bool_or(coalesce(list_contains(m.segments, s.segment), false)) as sealed, min(m.checkpoint_seq) as mark
        from segment_entries s, m group by 1, 2)
  select external_id, seq from e where acked and (seq > mark or not sealed)""")
def p3_found(spark, folder):
    run = incremental.IncrementalRun(spark, scratch_folder(spark, "incremental"), key=("seq", "external_id"))
    run.start_from(incremental.last_good_manifest(table(spark, folder, "manifests")))
    run.run(table(spark, folder, "segment_entries"), lambda due: due.select("external_id", "seq"), columns=["external_id", "seq"])
    return run.result()


@query(f"""with {_ENTRIES}, m as (select external_id, max(seq) as seq from a where lifecycle in (0, 1) group by 1)
  select distinct external_id from records where external_id in (select m.external_id from m join a using (external_id, seq) where a.lifecycle = 0)""")
def liveness_semijoin(spark, folder):
    ids = table(spark, folder, "records").select("external_id").distinct()
    return ids.join(p2_found(spark, folder).select("external_id"), "external_id", "left_semi")


@query(f"""with {_ENTRIES}, x as (select external_id, max(seq) as seq from a where lifecycle in (0, 1) group by 1)
  select lifecycle, count(*) as n from (select distinct a.external_id, a.seq, a.lifecycle from a join x using (external_id, seq) where a.lifecycle in (0, 1)) group by lifecycle""")
def latest_by_lifecycle(spark, folder):
    every = changes.acknowledged_changes(table(spark, folder, "records"), table(spark, folder, "segment_entries")).where("lifecycle in (0, 1)")
    return liveview.latest(every, "external_id", "seq").groupBy("lifecycle").agg(F.count("*").alias("n"))


@query("""with f as (select seq, external_id, min(commit_seq) as first from segment_entries group by all having first is not null), m as (select quantile_disc(first, 0.5) as half from f)
  select seq, external_id, case when first <= half then 1 else 2 end as run from f, m""")
def incremental_two_runs(spark, folder):
    """Half of the commits, then all of them, with a run between that dies before it publishes. Copies of
    entries of the first run that are acknowledged later don't come again."""
    entries = table(spark, folder, "segment_entries")
    half = entries.groupBy("seq", "external_id").agg(F.min("commit_seq").alias("first")).where("first is not null").agg(F.expr("percentile_disc(0.5) within group (order by first)")).first()[0]
    run = incremental.IncrementalRun(spark, scratch_folder(spark, "incremental"), key=("seq", "external_id"))

    def job(number):
        return lambda rows: rows.select("seq", "external_id", F.lit(number).alias("run"))

    def die():
        raise InterruptedError("executor and driver lost")

    keys = ["seq", "external_id"]
    run.run(entries.where(F.col("commit_seq") <= half), job(1), columns=keys)
    try:
        run.run(entries, job(-1), columns=keys, before_publish=die)
    except InterruptedError:
        pass
    run.run(entries, job(2), columns=keys)
    return run.result()


@query(SQL["p2_found"])
def change_files_compacted(spark, folder):
    """Two batches of the feed in the wrong order, some of it twice, compacted in between."""
    every = changes.acknowledged_changes(table(spark, folder, "records"), table(spark, folder, "segment_entries"))
    files = changes.ChangeFiles(spark, scratch_folder(spark, "changes"), "external_id", "seq")
    kinds = {"is_insert": F.col("lifecycle") == 0, "is_delete": F.col("lifecycle") == 1}
    files.append(every.where("seq % 3 > 0"), **kinds)
    files.compact()
    files.append(every.where("seq % 3 < 2"), **kinds)
    return files.read()

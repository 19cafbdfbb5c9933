"""Vector, text and fused ranking on hand-computed frames and against brute force."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from quernstone.errors import SchemaError
from quernstone.functions import text as tx, vector as vec
from quernstone.functions.vector import Metric
from quernstone.operators import bm25, fusion, timing, topk

POINTS = [(1, 10, [1.0, 0.0]), (2, 11, [0.9, 0.1]), (3, 12, [0.0, 1.0]), (4, 13, [-1.0, 0.0]), (5, 14, [0.0, 0.0]), (6, 15, None), (7, 16, [1.0]), (8, 17, [1.0, 0.0])]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "id long, seq long, vector array<float>").cache()


def got(df):
    return [(r.id, round(r.score, 6)) for r in df.collect()]


def test_metrics_ties_and_zero_vectors(points):
    assert got(topk.exact_top_k(points, [1, 0], 4, "dot")) == [(1, 1.0), (8, 1.0), (2, 0.9), (3, 0.0)]
    assert got(topk.exact_top_k(points, [2, 0], 10, "cosine")) == [(1, 1.0), (8, 1.0), (2, round(0.9 / math.hypot(0.9, 0.1), 6)), (3, 0.0), (4, -1.0)]
    assert got(topk.exact_top_k(points, [1, 0], 3, "l2")) == [(1, 0.0), (8, 0.0), (2, -0.02)]
    assert topk.exact_top_k(points, [1, 0], 2).columns == ["id", "score", "seq"]


def test_prefix_query_compares_prefixes(points):
    assert got(topk.exact_top_k(points, [2], 4, "cosine", dim=2)) == [(1, 1.0), (2, 1.0), (7, 1.0), (8, 1.0)]
    assert got(topk.exact_top_k(points, [0.9], 1, "l2"))[0][0] == 2


def test_k_edges_filter_and_empty(points):
    assert topk.exact_top_k(points, [1, 0], 0).count() == 0
    assert topk.exact_top_k(points, [1, 0], 99).count() == 6
    assert topk.exact_top_k(points.limit(0), [1, 0], 3).count() == 0
    assert [i for i, _ in got(topk.exact_top_k(points, [1, 0], 2, "dot", where=F.col("id") > 1))] == [8, 2]
    for bad in (-1, True, 1.5):
        with pytest.raises(SchemaError):
            topk.exact_top_k(points, [1, 0], bad)


@pytest.mark.parametrize("query,metric,dim", [([], "l2", 2), ([1, 2, 3], "l2", 2), ([0, 0], "cosine", 2), ([float("nan")], "dot", 2), ([1], "hamming", 2)])
def test_bad_queries(points, query, metric, dim):
    with pytest.raises(SchemaError):
        topk.exact_top_k(points, query, 1, metric, dim=dim)


def test_single_precision_mode_folds_in_order(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((2, 50)).astype(np.float32)
    want = np.float32(0)
    for x, y in zip(a, b):
        want = np.float32(want + np.float32(x * y))
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<float>, b array<float>")
    assert np.float32(df.select(vec.dot(F.col("a"), F.col("b"), "float")).first()[0]) == want
    assert df.select(vec.norm(F.array())).first()[0] == 0.0


def test_is_finite(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [math.nan]), (3, [math.inf]), (4, [None]), (5, None), (6, [])], "id int, v array<double>")
    assert [r[0] for r in df.where(vec.is_finite(F.col("v"))).orderBy("id").select("id").collect()] == [1, 6]


@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_batch_equals_brute_force(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (300, 4)).astype(np.float32)  # small integers: many ties
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)] + [(900, None, ""), (901, [1.0], ""), (902, [math.nan] * 4, ""), (None, [1.0] * 4, "")]
    df = spark.createDataFrame(rows, "id long, vector array<float>, qid string").repartition(5)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 30)] + [(5000, None), (0, x[0].tolist())], "qid long, qvector array<float>")
    for size in (topk.QUERY_BYTES, 4 * 8 * 3):
        found = topk.batch_top_k(df, q, 7, metric, dim=4, query_bytes=size).collect()
        by = {}
        for r in found:
            by.setdefault(r.qid, []).append((r["rank"], r.id, r.score))
        for i in range(0, 300, 30):
            a, y = x[i].astype(float), x.astype(float)
            if metric == "dot":
                s = y @ a
            elif metric == "l2":
                s = -((y - a) ** 2).sum(1)
            else:
                with np.errstate(all="ignore"):
                    s = (y @ a) / (np.linalg.norm(y, axis=1) * np.linalg.norm(a))
            s = np.round(s, 9)
            order = sorted((j for j in range(300) if np.isfinite(s[j])), key=lambda j: (-s[j], j))[:7]
            if metric == "cosine" and not a.any():
                assert i not in by
                continue
            assert [(n, j) for n, j, _ in sorted(by[i])] == list(enumerate(order, 1))
        assert 5000 not in by
    assert topk.batch_top_k(df, q.limit(0), 3, metric, dim=4).count() == 0
    assert topk.batch_top_k(df.limit(0), q, 3, metric, dim=4).count() == 0


def test_recall(spark):
    truth = spark.createDataFrame([(1, 1), (1, 2), (2, 5), (2, 5), (3, 9)], "qid long, id long")
    found = spark.createDataFrame([(1, 1), (1, 7), (2, 5), (4, 4)], "qid long, id long")
    r = topk.recall_at_k(found, truth, 2).first()
    assert (r.queries, r.k, r.min_recall, r.passed) == (3, 2, 0.0, False) and abs(r.mean_recall - 0.5) < 1e-12
    assert topk.recall_at_k(found.limit(0), truth.limit(0), 2).first().mean_recall == 1.0
    assert topk.recall_at_k(truth, truth, 2).first().passed


WORDS = [
    ("Hello, World!", ["hello", "world"]), ("install_x v1.2.3", ["install", "x", "v1", "2", "3"]), ("Grüße AUS Köln", ["grüße", "aus", "köln"]),
    ("日本語 テスト", ["日本語", "テスト"]), ("", []), (None, []), ("... --- !!!", []), ("ΟΔΟΣ", ["οδοσ"]), ("İx", ["i̇x"]), ("a\u0301b", ["a", "b"]), ("x²y ½", ["x²y", "½"]),
]


@pytest.mark.parametrize("text,want", WORDS)
def test_words(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.words(F.col("t"))).first()[0] == want
    assert [(r.pos, r.token) for r in tx.with_positions(df, "t").collect()] == list(enumerate(want))
    assert {(r.term, r.tf, r.dl) for r in tx.term_counts(df, "t").collect()} == {(w, n, len(want)) for w, n in Counter(want).items()}


DOCS = [(1, 1, "cat cat dog"), (2, 2, "dog"), (3, 3, None), (4, 4, "Cat fish bird whale"), (5, 5, "...")]


def brute_bm25(docs, query, k):
    toks = {i: (t or "").lower().replace(".", "").split() for i, _, t in docs}
    n, avgdl = len(toks), max(sum(map(len, toks.values())) / len(toks), 1.0)
    out = []
    for i, w in toks.items():
        s = 0.0
        for t in query.lower().split():
            df, tf = sum(t in x for x in toks.values()), w.count(t)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avgdl))
        if s > 0:
            out.append((i, round(s, 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:k]


@pytest.mark.parametrize("query", ["cat", "dog cat", "cat cat dog", "Fish", "nothing", "", "..."])
def test_bm25(spark, query):
    df = spark.createDataFrame(DOCS, "id long, seq long, text string")
    want = brute_bm25(DOCS, query.replace(".", ""), 10)
    assert got(bm25.text_top_k(df, query, 10)) == want
    assert got(bm25.text_top_k_from_postings(bm25.postings(df), bm25.corpus_stats(df), query, 10)) == want
    some = [d for d in DOCS if d[0] != 1]
    assert got(bm25.text_top_k(df, query, 2, where=F.col("id") != 1)) == brute_bm25(some, query.replace(".", ""), 2)


def test_bm25_empty(spark):
    df = spark.createDataFrame([], "id long, seq long, text string")
    assert bm25.text_top_k(df, "cat", 3).count() == 0
    assert tuple(bm25.corpus_stats(df).first()) == (0, 1.0)
    assert bm25.postings(df).count() == 0


def path(spark, rows):
    return spark.createDataFrame([(i, float(s), i + 100) for i, s in rows], "id long, score double, seq long")


def test_rrf(spark):
    a, b = path(spark, [(1, 9), (2, 8), (3, 7)]), path(spark, [(3, 0.5), (2, 0.4)])
    want = [(3, 1 / 63 + 1 / 61), (2, 1 / 62 + 1 / 62), (1, 1 / 61)]
    assert got(fusion.rrf([a, b], 5)) == [(i, round(s, 6)) for i, s in want]
    scaled = b.withColumn("score", F.col("score") * 1e9 - 7)
    assert got(fusion.rrf([a, scaled], 5)) == got(fusion.rrf([a, b], 5))
    assert got(fusion.rrf([a], 2)) == [(1, round(1 / 61, 6)), (2, round(1 / 62, 6))]
    assert fusion.rrf([a, b], 0).count() == 0 and fusion.rrf([a.limit(0), b.limit(0)], 3).count() == 0
    tie = fusion.rrf([path(spark, [(9, 1), (4, 0)]), path(spark, [(4, 1), (9, 0)])], 2)
    assert [i for i, _ in got(tie)] == [4, 9]
    assert fusion.rrf([b, a.withColumn("seq", F.lit(0).cast("long"))], 3).where("id = 3").first().seq == 103
    with pytest.raises(SchemaError):
        fusion.rrf([], 3)


def test_metric_names():
    assert Metric.of("L2") is Metric.L2 and Metric.of(0) is Metric.DOT and Metric.of(Metric.COSINE) is Metric.COSINE
    for bad in ("x", 7, None, True):
        with pytest.raises(SchemaError):
            Metric.of(bad)


def test_spread_touches_small_scans_only(spark, tmp_path):
    from quernstone.operators.bounds import spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    spark.range(1000).repartition(8).write.parquet(str(tmp_path / "eight"))
    one, eight = (spark.read.parquet(str(tmp_path / n)) for n in ("one", "eight"))
    assert spread(one.where("id > 5").select("id")).rdd.getNumPartitions() == 8
    assert sorted(r.id for r in spread(one).collect()) == list(range(1000))
    assert "Exchange" not in spread(eight)._jdf.queryExecution().executedPlan().toString()
    grouped = one.groupBy("id").count()
    assert spread(grouped) is grouped and spread(one.limit(0)).count() == 0


def test_fusion_by_key(spark):
    rows = [(1, "a", 5, 0.9), (1, "a", 5, 0.1), (1, "a", 6, 0.9), (1, "b", 6, 3.0), (1, "b", None, 9.0), (1, "b", 7, float("nan")), (2, None, 5, 1.0), (None, "a", 5, 1.0), (3, "a", 8, None), (4, "a", 2, 1.0), (4, "b", 1, 9.0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "query_id long, path string, external_id long, score double, rank string, _k int")
    got = [tuple(r) for r in fusion.rrf_by_key(df, 5).orderBy("query_id", "rank").collect()]
    assert got == [(1, 6, round(1 / 62 + 1 / 61, 9), 1), (1, 5, round(1 / 61, 9), 2), (4, 1, round(1 / 61, 9), 1), (4, 2, round(1 / 61, 9), 2)]
    assert fusion.rrf_by_key(df, 0).count() == 0 and fusion.rrf_by_key(df.limit(0), 3).count() == 0
    many = spark.range(20).select("id", F.col("id").cast("double").alias("score"))
    assert fusion.rrf([many], 3, window=20).count() == 3
    with pytest.raises(Exception, match="more than 19 hits"):
        fusion.rrf([many], 3, window=19).collect()


def test_timing_summary(spark):
    df = spark.createDataFrame([("a", 1.0, 7), ("a", 3.0, 7), ("a", None, 7), ("a", float("nan"), 7), ("b", 2.0, 7), (None, 4.0, 7)], "k string, value double, n int")
    got = {r.k: (r.n, r["mean"], r.p50, round(r.p99, 9)) for r in timing.timing_summary(df, "value", "k").collect()}
    assert got == {"a": (2, 2.0, 2.0, 2.98), "b": (1, 2.0, 2.0, 2.0), None: (1, 4.0, 4.0, 4.0)}
    assert timing.timing_summary(df.limit(0), "value").first().n == 0


def test_one_in_for_all_values_of_a_kind(spark):
    df = spark.range(100).select("id", F.col("id").cast("double").alias("x"))
    from quernstone.plans import Fields, In, Not, filter_column

    node = In("id", tuple(range(0, 5000, 7)))
    plan = df.where(filter_column(node, Fields.of(df)))
    assert plan.count() == 15 and " OR " not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert df.where(filter_column(Not(In("id", (1, 2))), Fields.of(df))).count() == 98
    assert df.where(filter_column(In("x", (1, 2.0, float("nan"))), Fields.of(df))).count() == 1

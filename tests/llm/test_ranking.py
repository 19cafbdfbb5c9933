"""Ideal-point rankings and reciprocal ranks against plain Python."""

import math
import random
from collections import defaultdict

import pytest
from quernstone.llm import ranking
from quernstone.llm.ranking import best_items, ideal_point, places

SCHEMA = "query_id long, path string, external_id long, score double, seq long, place long, value double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], SCHEMA).repartition(4)


def some_hits(seed, hot=0):
    rng = random.Random(seed)
    rows = []
    for q in range(6):
        for p, scale in (("a", 1), ("b", 1e6), ("c", -3)):
            if rng.random() < 0.85:
                rows += [(q, p, rng.randrange(30), round(scale * rng.random(), 2) if rng.random() < 0.9 else rng.choice([None, float("nan")])) for _ in range(25)]
    rows += [(99, "a", i, float(i % 17)) for i in range(hot)]
    return rows + [(None, "a", 1, 1.0), (1, None, 1, 1.0), (1, "a", None, 1.0)]


def best_of(rows):
    best = {}
    for q, p, i, s in rows:
        if None not in (q, p, i, s) and not math.isnan(s):
            best[q, p, i] = max(s, best.get((q, p, i), -math.inf))
    return best


def brute_rrf(rows, k=10):
    lists = defaultdict(list)
    for (q, p, i), s in best_of(rows).items():
        lists[q, p].append((-s, i))
    total = defaultdict(float)
    for (q, p), hits in lists.items():
        for n, (_, i) in enumerate(sorted(hits), 1):
            total[q, i] += 1 / (60 + n)
    out = set()
    for q in {q for q, _ in total}:
        order = sorted((-round(s, 9), i) for (x, i), s in total.items() if x == q)[:k]
        out |= {(q, i) for _, i in order}
    return out


@pytest.mark.parametrize("window_rows", [ranking.WINDOW_ROWS, 20])
def test_reciprocal_ranks(spark, monkeypatch, window_rows):
    rows = some_hits(1, hot=400)
    monkeypatch.setattr(places, "__defaults__", (window_rows,))
    got = best_items(ideal_point(frame(spark, rows), scale="reciprocal_rank", power=1), 10, by="to_anti")
    assert {(r.query_id, r.external_id) for r in got.collect()} == brute_rrf(rows)
    assert {(r.query_id, r.external_id) for r in best_items(ideal_point(frame(spark, rows), scale="reciprocal_rank", power=1), 10).collect()} == brute_rrf(rows)


def brute_topsis(rows):
    paths = defaultdict(dict)
    for (q, p, i), s in best_of(rows).items():
        paths[q, p][i] = s
    points, marks = defaultdict(dict), defaultdict(dict)
    for (q, p), items in paths.items():
        v = sorted(items.values())
        lo, hi = v[max(0, math.ceil(0.05 * len(v)) - 1)], v[max(0, math.ceil(0.95 * len(v)) - 1)]
        clip = {i: min(max(s, lo), hi) for i, s in items.items()}
        length = math.sqrt(sum(s * s for s in clip.values())) or 1.0
        marks[q][p] = (min(clip.values()) / length, max(clip.values()) / length)
        for i, s in clip.items():
            points[q, i][p] = s / length
    out = {}
    for (q, i), v in points.items():
        anti = math.sqrt(sum((v.get(p, m[0]) - m[0]) ** 2 for p, m in marks[q].items()))
        ideal = math.sqrt(sum((m[1] - v.get(p, m[0])) ** 2 for p, m in marks[q].items()))
        out[q, i] = anti / (anti + ideal) if anti + ideal > 0 else 0.0
    return out


def test_ideal_point(spark):
    rows = some_hits(2)
    want = brute_topsis(rows)
    got = {(r.query_id, r.external_id): r.closeness for r in ideal_point(frame(spark, rows)).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-7 for x in want)


def test_scale_of_a_path_does_not_matter(spark):
    rows = [(1, "a", i, float(i)) for i in range(10)] + [(1, "b", i, float((i * 7) % 10)) for i in range(10)]
    scaled = [(q, p, i, s * 1e9 if p == "b" else s) for q, p, i, s in rows]
    order = [[r.external_id for r in best_items(ideal_point(frame(spark, x)), 10).orderBy("rank").collect()] for x in (rows, scaled)]
    assert order[0] == order[1]
    heavy = best_items(ideal_point(frame(spark, rows), weights={"a": 100.0}), 1).first()
    assert heavy.external_id == 9


def test_edges(spark):
    assert ideal_point(frame(spark, [])).count() == 0
    same = ideal_point(frame(spark, [(1, "a", 3, 2.0), (1, "a", 2, 2.0)]))
    assert [r.external_id for r in best_items(same, 5).orderBy("rank").collect()] == [2, 3]
    inf = ideal_point(frame(spark, [(1, "a", 1, float("inf")), (1, "a", 2, 0.0)]), scale="reciprocal_rank", power=1)
    assert best_items(inf, 1).first().external_id == 1
    for bad in (dict(scale="z"), dict(power=3), dict(low=0.9, high=0.1)):
        with pytest.raises(ValueError):
            ideal_point(frame(spark, []), **bad)


def test_winsor_edges_of_a_large_group_are_exact(spark):
    from pyspark.sql import functions as F

    n = 300_000
    hits = spark.range(n, numPartitions=6).select(F.lit(1).cast("long").alias("query_id"), F.lit("a").alias("path"), F.col("id").alias("external_id"), ((F.col("id") * 7919) % n).cast("double").alias("score"))
    c = ideal_point(hits).agg(F.sum((F.col("closeness") == 0).cast("long")).alias("low"), F.sum((F.col("closeness") == 1).cast("long")).alias("high")).first()
    assert (c.low, c.high) == (n // 20, n // 20 + 1)

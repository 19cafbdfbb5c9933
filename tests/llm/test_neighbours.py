"""Nearest vectors against brute force."""

import numpy as np
import pytest
from quernstone.llm import neighbours
from quernstone.llm.neighbours import similar_pairs

SCHEMA = "external_id long, vector array<float>, shard string, home string, a long"


def brute(rows, dim, k, least):
    one = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == dim and None not in v:
            x = np.array(v, dtype=np.float64)
            if np.isfinite(x).all() and x.any():
                one[i] = x / np.linalg.norm(x)
    ids = np.array(sorted(one))
    if len(ids) < 2:
        return set()
    u = np.stack([one[i] for i in ids])
    c = np.round(u @ u.T, 12)
    out = set()
    for a in range(len(ids)):
        order = [b for b in np.lexsort((ids, -c[a])) if b != a][:k]
        out |= {(min(ids[a], ids[b]), max(ids[a], ids[b])) for b in order if c[a, b] >= least}
    return {(int(a), int(b)) for a, b in out}


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s", "h", 1) for i, v in rows], SCHEMA).repartition(6)
    got = [tuple(r) for r in similar_pairs(df, **kw).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


def families(n, dim, seed, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    x = centres[rng.integers(len(centres), size=n)] + spread * rng.standard_normal((n, dim))
    x *= 10 ** rng.uniform(-2, 2, (n, 1))  # lengths differ widely
    return [(int(i), v.astype(np.float32).tolist()) for i, v in zip(rng.permutation(10 * n)[:n], x)]


def test_relax_one_is_exact_over_many_shards(spark):
    rows = families(400, 12, 1)
    assert found(spark, rows, dim=12, k=4, relax=1.0, shard_rows=40, leaf=8) == brute(rows, 12, 4, 0.9)


def test_default_relaxation_keeps_recall(spark):
    rows = families(3000, 48, 2, 0.2)
    want = brute(rows, 48, 10, 0.9)
    got = found(spark, rows, dim=48, shard_rows=300, leaf=32)
    assert len(want) > 2000 and len(got & want) / len(want) >= 0.97 and len(got - want) / len(got) < 0.02


def test_dirt(spark):
    good = [(1, [1, 0, 0]), (2, [2, 0, 0]), (3, [1, 0.1, 0]), (9, [0, 1, 0])]
    bad = [(None, [1, 0, 0]), (4, None), (5, []), (6, [1, 0]), (7, [0, 0, 0]), (8, [1, None, 0]), (10, [1, float("nan"), 0]), (11, [1, float("inf"), 0]), (12, [1, 0, 0, 0])]
    assert found(spark, good + bad + good, dim=3, relax=1.0) == brute(good, 3, 10, 0.9) == {(1, 2), (1, 3), (2, 3)}


def test_few_rows(spark):
    assert found(spark, [], dim=3) == set()
    assert found(spark, [(1, [1, 2, 3])], dim=3) == set()
    assert found(spark, [(1, [0, 0, 0]), (2, [0, 0, 0])], dim=3) == set()
    for bad in (dict(min_cosine=-2), dict(relax=1.5), dict(k=0)):
        with pytest.raises(ValueError):
            found(spark, [], dim=3, **bad)


def test_a_third_of_all_rows_is_one_vector(spark):
    rows = families(300, 8, 3)
    copies = [(50_000 + i, [1.0] * 8) for i in range(150)] + [(70_000 + i, [0.0] * 8) for i in range(100)]
    near = [(90_000 + i, [1.0] * 7 + [1.0 + 0.01 * i]) for i in range(1, 4)]
    every = rows + copies + near
    assert found(spark, every, dim=8, k=5, relax=1.0, shard_rows=60, leaf=8) == brute(every, 8, 5, 0.9)


def test_few_good_vectors_among_copies_and_faulty_ones(spark):
    nan = float("nan")
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(600)] + [(1000 + i, [float(i), nan, 1.0]) for i in range(400)]
    rows += [(5000 + i, [0.01 * i, 1.0, 0.0]) for i in range(3)]
    assert found(spark, rows, dim=3, k=3, relax=1.0) == brute(rows, 3, 3, 0.9)


def test_dense_ball_of_different_vectors(spark):
    rng = np.random.default_rng(5)
    ball = np.array([1.0] + [0.0] * 15) + 0.01 * rng.standard_normal((400, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(ball)] + [(1000 + i, v) for i, v in families(200, 16, 6)]
    want = brute(rows, 16, 5, 0.9)
    got = found(spark, rows, dim=16, k=5, relax=0.5, shard_rows=50, leaf=16)
    assert len(got & want) / len(want) >= 0.95


def test_ties_prefer_smaller_ids(spark):
    rows = [(i, [1.0, 0.0]) for i in range(1, 8)]
    assert found(spark, rows, dim=2, k=2, relax=1.0) == brute(rows, 2, 2, 0.9)


def test_close_copies_and_float_multiples_keep_their_order(spark):
    rng = np.random.default_rng(8)
    v, w = rng.standard_normal((2, 24))
    rows = [(int(i), (v * (1 + 3e-5 * rng.standard_normal(24))).astype(np.float32).tolist()) for i in rng.permutation(400)]
    rows += [(1000 + int(i), (w * f).astype(np.float32).tolist()) for i, f in zip(rng.permutation(400), 10 ** rng.uniform(-2, 2, 400))]
    rows += [(2000 + i, x) for i, x in families(400, 24, 9)]
    want = brute(rows, 24, 10, 0.9)
    for kw in (dict(), dict(relax=1.0), dict(shard_rows=300)):
        got = found(spark, rows, dim=24, **kw)
        assert len(got & want) / len(want) >= 0.99 and len(got - want) / len(got) <= 0.01


def test_multiples_of_a_vector_beyond_the_smallest_ids(spark):
    v = [1.0, -0.5, 0.0, 3.0, 0.25, -0.0, 1.5, 2.0]
    copies = [(50_000 + i, v) for i in range(120)]
    multiples = [(i - 10, [2.0 ** (i + 1) * x for x in v]) for i in range(4)] + [(60_000 + i, [(i + 3) * x for x in v]) for i in range(60)]
    near = [(-20, [3.0 * x * 1.1 for x in v]), (-15, [x + 0.001 for x in v])]  # the first is a multiple but for rounding
    every = families(200, 8, 4) + copies + multiples + near
    assert found(spark, every, dim=8, k=5, relax=1.0, shard_rows=60, leaf=8) == brute(every, 8, 5, 0.9)


def test_multiples_share_a_direction():
    v = np.array([[float(f) * x for x in (1.0, -0.5, 0.0, 3.0)] for f in range(1, 40)] + [[1.0, -0.5, -0.0, 3.0]], np.float32)
    other = np.array([[-1.0, 0.5, 0.0, -3.0], [1.0, -0.5, 0.0, 3.0000002]], np.float32)
    exact, _ = neighbours.direction_hashes(np.concatenate((v, other)), neighbours._unit(np.concatenate((v, other)))[0])
    assert len(set(exact.tolist())) == 3
    rng = np.random.default_rng(3)
    w = (rng.standard_normal(64) * 10 ** rng.uniform(-3, 3, (5000, 1))).astype(np.float32)
    u, _ = neighbours._unit(w)
    exact, cell = neighbours.direction_hashes(w, u)
    assert len(set(exact.tolist())) > 4000 and len(set(cell.tolist())) < 1500
    for g in list(set(cell.tolist()))[:50]:
        assert (np.round(u[cell == g] @ u[cell == g].T, 12) == 1).all()


def test_a_hot_direction_of_rounded_multiples(spark):
    rng = np.random.default_rng(4)
    w = rng.standard_normal(16)
    rows = [(1000 + int(i), (w * f).astype(np.float32).tolist()) for i, f in zip(rng.permutation(900), 10 ** rng.uniform(-2, 2, 900))]
    rows += [(5000 + i, (w + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(30)] + [(10_000 + i, v) for i, v in families(200, 16, 5)]
    want = brute(rows, 16, 5, 0.9)
    for kw in (dict(relax=1.0, shard_rows=200), dict(shard_rows=400)):
        got = found(spark, rows, dim=16, k=5, leaf=32, **kw)
        assert len(got & want) / len(want) >= 0.98 and len(got - want) / len(got) <= 0.02


def test_no_least_cosine(spark):
    rows = families(500, 12, 7)
    assert found(spark, rows, dim=12, k=4, min_cosine=None, relax=1.0, shard_rows=60, leaf=16) == brute(rows, 12, 4, -1)
    want = brute(rows, 12, 4, -1)
    got = found(spark, rows, dim=12, k=4, min_cosine=None, relax=0.3, shard_rows=200)
    assert len(got & want) / len(want) >= 0.9


def test_cells_that_hold_too_much_get_more_pivots(spark):
    rng = np.random.default_rng(11)
    ball = np.array([1.0] + [0.0] * 7) + 0.05 * rng.standard_normal((1500, 8))
    far = rng.standard_normal((300, 8))
    x = np.concatenate((ball, far)).astype(np.float32)
    u, _ = neighbours._unit(x)
    h, _ = neighbours.direction_hashes(x, u)
    df = spark.createDataFrame([(int(a), v.tolist()) for a, v in zip(h, x)], "h long, v array<float>").repartition(4)
    few = u[-4:].astype(np.float32)  # none in the ball
    more = neighbours._more_pivots(df, few, 100, 8, 0.07, 3)
    assert {tuple(p) for p in few.tolist()} <= {tuple(p) for p in more.tolist()}
    before, after = (np.bincount((u @ p.T).argmax(1)).max() for p in (few, more))
    assert before > 400 and after <= 400 and len(more) < 60


def test_groups_of_pivots_lose_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 6))[rng.integers(40, size=900)] + 0.2 * rng.standard_normal((900, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pivots = u[:300].astype(np.float32)
    flat = neighbours._Pivots(pivots, 1.0, 1)
    monkeypatch.setattr(neighbours, "FLAT_PIVOTS", 10)
    for relax in (1.0, 0.07):
        grouped = neighbours._Pivots(pivots, relax, 1)
        for r in (0.1, 0.45):
            sets = []
            for known in (flat, grouped):
                row, cell, d = known.near(u, u.astype(np.float32), r)
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                least = np.repeat(d[starts], np.diff(np.append(starts, len(row))))
                sets.append(set(zip(row[d <= least + 2 * relax * r].tolist(), cell[d <= least + 2 * relax * r].tolist())))
            assert len(sets[1] & sets[0]) >= (0.9999 if relax == 1 else 0.9) * len(sets[0])


def test_shards_get_partitions_of_their_own(spark):
    from pyspark.sql import functions as F

    labels = neighbours._labels(spark, 13)
    df = spark.createDataFrame([(int(x),) for x in labels], "s int")
    assert df.select(F.pmod(F.hash("s"), F.lit(13))).distinct().count() == 13

"""Durable collection: writes, transactions, recovery, index, streaming."""

import glob
import json
import math
import os
import random
import shutil
import tracemalloc

import numpy as np
import pytest
import quernstone as qs
from pyspark.sql import functions as F
from quernstone.operators import ann, topk
from quernstone.operators.ann import FlatIndex, IvfConfig, IvfIndex
from quernstone.sources import synth
from quernstone.sources.store import Store


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "c")


def ids(c, *a, **k):
    return [h.id for h in c.hits(c.exact_search(*a, **k))]


def test_round_trip_of_all_kinds(spark, folder):
    c = qs.connect(spark, folder, metric="cosine")
    meta = {"i": 7, "f": 1.5, "b": True, "s": "x" * 300, "y": b"\x00\xff", "none": None}
    assert c.add([5, 3], [[1, 2], [3, 4]], ["Grüße", None], [meta, None], [2.5, None]) == 2
    d = qs.connect(spark, folder)
    assert (d.dim, d.id_kind, d.metric, len(d), d.is_empty()) == (2, "int", "cosine", 2, False)
    r = d.get(5)
    assert r["vector"] == [1.0, 2.0] and r["text"] == "Grüße" and r["norm"] == 2.5
    assert r["meta"] == {"i": 7, "f": 1.5, "b": True, "s": "x" * 300, "y": bytearray(b"\x00\xff")} and r["meta"]["b"] is True
    assert d.get([9, 3])[0] is None and d.get([9, 3])[1]["external_id"] == 3 and d.get([3])["external_id"] == 3 and d.get([]) == []
    assert d.get("3") is None and d.is_live(3) and not d.is_live(4)
    assert [x.id for x in d.scan().collect()] == [5, 3]


def test_last_wins_delete_and_reinsert(spark, folder):
    c = qs.connect(spark, folder)
    c.add([1, 2, 1], [[1, 0], [0, 1], [5, 5]], ["a", "b", "c"])
    assert len(c) == 2 and c.get(1)["text"] == "c"
    c.upsert(2, [7, 7])
    assert c.get(2)["text"] is None  # the whole record is replaced
    c.delete([1])
    assert c.get(1) is None and len(c) == 1
    with pytest.raises(qs.SchemaError):
        c.delete([2, 1])
    assert len(c) == 1  # all or nothing
    c.upsert(1, [2, 2])
    assert ids(c, [2, 2], 5) == [1, 2]


@pytest.mark.parametrize("bad", [
    dict(ids=[1], vectors=[[1, math.nan]]), dict(ids=[1], vectors=[[1, math.inf]]), dict(ids=[1], vectors=[[]]), dict(ids=[1], vectors=[None]), dict(ids=[1], vectors=[[1, 2, 3]]),
    dict(ids=[1, 2], vectors=[[1, 2]]), dict(ids=[1], vectors=[[1, 2]], text=["a", "b"]), dict(ids=[-1], vectors=[[1, 2]]), dict(ids=[True], vectors=[[1, 2]]), dict(ids=["x"], vectors=[[1, 2]]),
    dict(ids=[], vectors=[]), dict(ids=[1, "a"], vectors=[[1, 2], [1, 2]]), dict(ids=[1], vectors=[[1, 2]], metadata=[{"k": [1]}]), dict(ids=[1], vectors=[[1, 2]], metadata=[{"k" * 70_000: 1}]),
    dict(ids=[None], vectors=[[1, 2]]), dict(ids=[1], vectors=[[1, 2]], norms=[math.inf]), dict(ids=[2**63], vectors=[[1, 2]]),
])
def test_faulty_batches_change_nothing(spark, folder, bad):
    c = qs.connect(spark, folder)
    c.add([0], [[0, 0]])
    with pytest.raises(ValueError):
        c.add(**bad)
    assert len(c) == 1 and len(qs.connect(spark, folder)) == 1


def test_settings_are_locked(spark, folder):
    c = qs.connect(spark, folder, metric="l2")
    c.set_metric("l2")
    with pytest.raises(qs.SchemaError):
        c.set_metric("dot")
    with pytest.raises(qs.SchemaError):
        qs.connect(spark, folder, metric="cosine")
    with pytest.raises(qs.SchemaError):
        qs.connect(spark, folder, safety="normal")
    c.add(["b", "a"], [[1, 0], [1, 0]])
    assert c.id_kind == "str" and ids(c, [1, 0], 2) == ["a", "b"]
    with pytest.raises(qs.SchemaError):
        c.delete(1)


def test_transaction(spark, folder):
    c = qs.connect(spark, folder)
    c.add([1], [[1, 1]], ["old"])
    with c.transaction():
        c.upsert(1, [2, 2], "new")
        c.add([2], [[3, 3]])
        assert c.get(1)["text"] == "new" and len(qs.Collection(spark, folder + "x")) == 0
        with pytest.raises(qs.TransactionError):
            with c.transaction():
                pass
        with pytest.raises(qs.TransactionError):
            c.checkpoint()
    assert len(qs.connect(spark, folder)) == 2
    with pytest.raises(KeyError):
        with c.transaction():
            c.upsert(1, [9, 9], "never")
            raise KeyError
    assert c.get(1)["text"] == "new" and len(c) == 2


def test_unmarked_writes_are_invisible(spark, folder):
    c = qs.connect(spark, folder, autocommit=False)
    c.add([1], [[1, 1]])
    c.commit()
    c.add([2], [[2, 2]])  # no commit: lost with the process
    d = qs.connect(spark, folder)
    assert [r.id for r in d.scan().collect()] == [1]
    d.add([3], [[3, 3]])
    assert [r.id for r in qs.connect(spark, folder).scan().collect()] == [1, 3]
    c.rollback()


def test_checkpoint_reopen_and_rebuild(spark, folder):
    c = qs.connect(spark, folder, metric="l2")
    c.add(list(range(10)), [[i, 0] for i in range(10)])
    c.delete([0, 1])
    assert c.checkpoint() == 1
    c.add([3, 50], [[99, 0], [50, 0]])
    want = sorted((r.id, r.seq) for r in c.scan().collect())
    assert sorted((r.id, r.seq) for r in qs.connect(spark, folder).scan().collect()) == want
    assert c.checkpoint() == 2
    assert c.store.files.names(folder + "/snapshots") == ["s-00000001", "s-00000002"]  # readers may still be at the one before
    shutil.rmtree(folder + "/snapshots/s-00000002")
    d = qs.connect(spark, folder)  # from the log
    assert sorted((r.id, r.seq) for r in d.scan().collect()) == want
    written = glob.glob(folder + "/commits/d-00000001-*/*.parquet")
    os.rename(written[0], folder + "/aside")
    with pytest.raises(qs.StorageError):  # rows are missing from the log
        qs.connect(spark, folder)
    os.rename(folder + "/aside", written[0])
    with open(folder + "/MANIFEST.json", "w") as f:
        f.write("{oops")
    with pytest.raises(qs.StorageError):
        qs.connect(spark, folder)


def test_pruned_log_needs_its_snapshot(spark, folder):
    c = qs.connect(spark, folder)
    c.add([1, 2], [[1, 1], [2, 2]])
    c.checkpoint(prune_log=True)
    assert len(qs.connect(spark, folder)) == 2
    shutil.rmtree(folder + "/snapshots")
    with pytest.raises(qs.StorageError):
        qs.connect(spark, folder)


def test_missing_committed_write_is_loud(spark, folder):
    c = qs.connect(spark, folder)
    c.add([1], [[1, 1]])
    shutil.rmtree(glob.glob(folder + "/commits/d-00000001-*")[0])
    with pytest.raises(qs.StorageError):
        qs.connect(spark, folder)


def test_an_open_reader_and_an_open_writer_lose_nothing(spark, folder):
    w = qs.connect(spark, folder, metric="l2")
    w.add([1, 2], [[1, 0], [2, 0]])
    w.checkpoint()
    before = qs.connect(spark, folder).frame()  # lazy, of the first snapshot
    with w.transaction():
        w.add([3], [[3, 0]])
        assert len(qs.connect(spark, folder)) == 2  # opening neither sees nor removes what is staged
        w.delete([1])
    assert sorted(r.id for r in qs.connect(spark, folder).frame().collect()) == [2, 3]
    tail = qs.connect(spark, folder).frame()
    w.checkpoint(prune_log=True)
    assert sorted(r.id for r in before.collect()) == [1, 2] and sorted(r.id for r in tail.collect()) == [2, 3]
    assert sorted(r.id for r in w.frame().collect()) == [2, 3]


def test_lease_and_generations(spark, folder):
    c = qs.connect(spark, folder, lease_s=0)
    c.add([1], [[1, 0]])
    shutil.copytree(glob.glob(folder + "/commits/d-*")[0], folder + "/commits/d-00000009-other")  # of a writer that died
    for i in range(3):
        c.add([i + 2], [[i, 1]])
        c.checkpoint()
    assert c.store.files.names(folder + "/snapshots") == ["s-00000002", "s-00000003"]
    left = c.store.files.names(folder + "/commits")
    assert not [n for n in left if n.startswith("c-") or "other" in n] and len([n for n in left if n.startswith("history")]) == 1
    d = qs.connect(spark, folder)
    d.add([50], [[0, 0]])
    shutil.rmtree(folder + "/snapshots")
    assert sorted(r.id for r in qs.connect(spark, folder).frame().collect()) == [1, 2, 3, 4, 50]  # from the history and newer markers


def test_two_writers_cannot_both_commit(spark, folder):
    a = qs.connect(spark, folder, autocommit=False)
    a.add([1], [[1, 0]])
    b = qs.connect(spark, folder, autocommit=False)
    b.add([2], [[2, 0]])
    a.commit()
    with pytest.raises(qs.StorageError):
        b.commit()
    b.rollback()
    assert [r.id for r in qs.connect(spark, folder).frame().collect()] == [1]
    c = qs.connect(spark, folder, autocommit=False)
    c.add([3], [[3, 0]])
    shutil.rmtree(glob.glob(folder + "/commits/d-*" + c.store.session)[0])
    with pytest.raises(qs.StorageError):
        c.commit()
    assert len(qs.connect(spark, folder)) == 1


def test_numbers_follow_input_order_over_partitions(spark, folder):
    c = qs.connect(spark, folder)
    df = spark.range(0, 1000, 1, 6).select("id", F.array(F.col("id").cast("float")).alias("vector"), (F.col("id") % 7).cast("string").alias("text"))
    c.add_frame(df)
    rows = c.scan().collect()
    assert [r.id for r in rows] == list(range(1000)) and [r.seq for r in rows] == list(range(1, 1001))
    assert c.add([5000], [[1.0]]) == 1002  # the commit used one


def test_typed_fields(spark, folder):
    c = qs.connect(spark, folder, fields={"year": "bigint", "lang": "string"})
    c.add([1, 2, 3], [[1, 0], [2, 0], [3, 0]], ["a b", "a", None], [{"year": 2020, "lang": "en"}, {"year": 2021}, None])
    assert ids(c, [0, 0], 5, where="year >= 2021 OR lang IS NULL") == [2, 3]
    assert ids(c, [0, 0], 5, where={"lang": "en"}) == [1]
    assert [h.id for h in c.hits(c.text_search("a", 5, where="year > 2020"))] == [2]
    with pytest.raises(qs.SchemaError):
        c.add([4], [[1, 1]], None, [{"other": 1}])
    assert c.get(2)["meta"] == {"year": 2021}


def test_hybrid(spark, folder):
    c = qs.connect(spark, folder, metric="l2")
    c.add([1, 2, 3], [[0, 0], [1, 0], [2, 0]], ["fish", "cat", "cat cat"], [{"k": 1}, {"k": 1}, {"k": 2}])
    assert [h.id for h in c.hits(c.hybrid_search(3, [0, 0], "cat"))] == [3, 2, 1]
    assert [h.id for h in c.hits(c.hybrid_search(3, [0, 0], "cat", where="k = 1"))] == [2, 1]
    assert [h.id for h in c.hits(c.hybrid_search(3, query_text="cat"))] == [3, 2]
    assert c.hybrid_search(0, [0, 0]).count() == 0
    for bad in (dict(k=3), dict(k=5, query_vector=[0, 0], window=4), dict(k=-1, query_vector=[0, 0])):
        with pytest.raises(qs.SchemaError):
            c.hybrid_search(**bad)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_index_recall_and_shadowing(spark, folder, metric):
    rng = np.random.default_rng(8)
    x = (rng.random((12, 8))[rng.integers(12, size=1500)] + 0.05 * rng.standard_normal((1500, 8))).astype(np.float32)
    c = qs.connect(spark, folder, metric=metric)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    c.add_frame(df)
    c.checkpoint()
    recalls = []
    for i in range(0, 1500, 300):
        exact, found = (c.hits(m(x[i].tolist(), 10)) for m in (c.exact_search, c.search))
        recalls.append(len({h.id for h in exact} & {h.id for h in found}) / 10)
        scores = {h.id: h.score for h in exact}
        assert all(abs(h.score - scores[h.id]) < 1e-12 for h in found if h.id in scores)
    assert sum(recalls) / len(recalls) >= 0.95
    q = x[42].tolist()
    best = c.hits(c.search(q, 1))[0].id
    c.delete(best)
    assert best not in [h.id for h in c.hits(c.search(q, 10))]
    second = c.hits(c.search(q, 1))[0].id
    c.upsert(second, (-x[42]).tolist())
    assert second not in [h.id for h in c.hits(c.search(q, 10))]
    c.upsert(9_999, q)
    assert c.hits(c.search(q, 1))[0].id == 9_999
    assert [h.id for h in c.hits(c.search(q[:3], 5))] == [h.id for h in c.hits(c.exact_search(q[:3], 5))]  # prefix: exact


def test_index_contract(spark, tmp_path):
    df = spark.createDataFrame([(i, i, [float(i), 0.0]) for i in range(300)] + [(900, 900, None), (901, 901, [math.nan, 1.0])], "id long, seq long, vector array<float>")
    with pytest.raises(qs.SchemaError):
        IvfIndex.build(df, str(tmp_path / "d"), "dot", 2)
    a = IvfIndex.build(df, str(tmp_path / "a"), "l2", 2, IvfConfig(lists=8, probes=1, target_recall=0))
    b = IvfIndex.build(df.repartition(5), str(tmp_path / "b"), "l2", 2, IvfConfig(lists=8, probes=1, target_recall=0))
    assert np.array_equal(a.centres.points, b.centres.points) and len(a) == 302
    plan = a.candidates([5.0, 0.0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list_id" in plan or "list_id" in plan.split("PartitionFilters")[1].split("]")[0]
    near = {r.id for r in a.candidates([5.0, 0.0], 3).collect()}
    assert {4, 5, 6} <= near and len(near) < 302
    empty = spark.createDataFrame([], "id long, seq long, vector array<float>, op string")
    hits = ann.indexed_search(a, empty, [5.0, 0.0], 3, "l2").collect()
    assert [r.id for r in hits] == [5, 4, 6]
    assert [r.id for r in ann.indexed_search(a, empty, [5.0, 0.0], 2, "dot").collect()] == [299, 298]
    queries = df.where("id in (0, 7, 299, 900, 901)").selectExpr("id as qid", "vector as qvector").unionByName(df.where("id = 7").selectExpr("id as qid", "vector as qvector"))
    got = {(r.qid, r["rank"]): r.id for r in a.batch_search(queries, 2, probes=2).collect()}
    assert got == {(0, 1): 0, (0, 2): 1, (7, 1): 7, (7, 2): 6, (299, 1): 299, (299, 2): 298}
    with pytest.raises(qs.SchemaError):
        a.candidates([5.0, 0.0], 3, pool=2)
    noise = np.random.default_rng(1).standard_normal((1500, 24))  # no clusters: many lists are needed
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(noise.astype(np.float32))], "id long, seq long, vector array<float>")
    c = IvfIndex.build(rows, str(tmp_path / "c"), "l2", 24)
    asked = rows.where("id % 50 = 0").selectExpr("id as qid", "vector as qvector")
    assert c.probes > 8
    assert topk.recall_at_k(c.batch_search(asked, 10), topk.batch_top_k(rows, asked, 10, "l2", dim=24), 10).first().mean_recall >= 0.95
    by_join = c.batch_search(asked, 10, query_bytes=8 * 24)  # more queries than may be sent to all tasks
    assert sorted(map(tuple, by_join.collect())) == sorted(map(tuple, c.batch_search(asked, 10).collect()))
    parts = c._met(asked.selectExpr("qid", "qvector as qv"), 10, c.probes, 9, part_rows=3)
    assert parts.groupBy("qid").agg(F.max("score").alias("s")).where("abs(s) > 1e-6").count() == 0
    flat = FlatIndex(df)
    assert len(flat) == 302 and flat.candidates([1.0], 1).count() == 302
    with pytest.raises(qs.StorageError):
        IvfIndex(spark, str(tmp_path / "none"))


def test_many_centres_stay_small():
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((40, 16))[rng.integers(40, size=12_000)] + 0.3 * rng.standard_normal((12_000, 16))).astype(np.float32)
    tracemalloc.start()
    points = ann.fit_centres(x, 4096, 3, 1)
    centres = ann.Centres(points)
    near = centres.nearest(x[:2000], 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 3900 <= len(centres) <= 4096 and near.shape == (2000, 8) and peak < 120e6  # 12,000 x 4,096 distances would be 197 MB
    exact = ann._nearest_flat(x[:2000], centres.points, centres.squares, 8)
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(near.tolist(), exact.tolist())]) > 0.97
    assert (near[:, 0] == exact[:, 0]).mean() > 0.98
    assert ann.fit_centres(np.zeros((5, 3)), 4, 2, 1).shape == (1, 3)


def test_generators_and_files(spark, tmp_path):
    u = synth.uniform(spark, 50, 4, seed=3)
    assert sorted(r.id for r in u.collect()) == list(range(1, 51))
    assert u.collect() == synth.uniform(spark, 50, 4, seed=3).collect()
    c = synth.clustered(spark, 40, 6, 4, spread=0.01)
    v = {r.id: np.array(r.vector) for r in c.collect()}
    assert np.linalg.norm(v[1] - v[5]) < 0.2 and len(v) == 40
    assert len(synth.clustered_queries(7, 6, 4)) == 7
    x = np.arange(3 * 128, dtype="<f4")
    data = np.array([3, 128], "<u8").tobytes() + x.tobytes() + np.array([1], "<u8").tobytes() + x[:128].tobytes()
    (tmp_path / "s.bin").write_bytes(data)
    rows, queries = synth.read_sift(spark, str(tmp_path / "s.bin"))
    assert rows.count() == 3 and rows.where("id = 2").first().vector[0] == 128.0 and len(queries[0]) == 128
    for bad in (data[:-5], np.array([1, 64], "<u8").tobytes() + data[16:]):
        (tmp_path / "s.bin").write_bytes(bad)
        with pytest.raises(qs.StorageError):
            synth.read_sift(spark, str(tmp_path / "s.bin"))
    synth.append_jsonl(str(tmp_path / "b.jsonl"), [{"a": 1}, {"b": 2}])
    assert [json.loads(x) for x in (tmp_path / "b.jsonl").read_text().splitlines()] == [{"a": 1}, {"b": 2}]


def test_stream_into_store(spark, folder, tmp_path):
    from quernstone.streaming import stream_into

    c = qs.connect(spark, folder)
    c.add([1], [[0, 0]], ["start"])
    src = str(tmp_path / "src")
    schema = "id long, vector array<float>, norm float, text string, meta " + qs.api.rows_from_columns.__globals__["META_TYPE"] + ", op string, ord long"
    rows = [(1, None, None, None, None, "delete", 1), (2, [1.0, 1.0], None, "x", None, "upsert", 2), (2, [2.0, 2.0], None, "y", None, "upsert", 3), (77, None, None, None, None, "delete", 4)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    q = stream_into(c.store, spark.readStream.schema(schema).parquet(src), str(tmp_path / "cp"))
    q.awaitTermination(120)
    d = qs.connect(spark, folder)
    assert [(r.id, r.text) for r in d.scan().collect()] == [(2, "y")]
    assert random.Random(1).random() < 1 and isinstance(d.store, Store)

"""Change feeds: current state, uncovered entries, incremental runs."""

import random

import pytest
from pyspark.sql import functions as F
from quernstone.errors import SchemaError, StorageError
from quernstone.operators import changes, incremental, liveview
from quernstone.operators.incremental import IncrementalRun

ENTRY = "seq long, external_id long, lifecycle int, commit_seq long, segment string, text string, extra string"


def state(df, **kw):
    return changes.current_state(df, "external_id", "seq", is_insert=F.col("lifecycle") == 0, is_delete=F.col("lifecycle") == 1, **kw)


def brute(rows):
    best = {}
    for i, s, life in rows:
        if i is not None and s is not None and life in (0, 1):
            if i not in best or (s, life == 0) > best[i]:
                best[i] = (s, life == 0)
    return {(i, s) for i, (s, live) in best.items() if live}


def test_current_state_in_any_order_with_repeats_and_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(2, 60), s, rng.choice([0, 0, 1, 2, None])) for s in range(400)]
    rows += rng.sample(rows, 150) + [(None, 5, 0), (7, None, 0)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, f"v{r[1]}") for r in rows], "external_id long, seq long, lifecycle int, note string")
    want = brute(rows)
    assert {(r.external_id, r.seq) for r in state(df).collect()} == want
    full = state(df.repartition(7), payload=["note", "lifecycle"]).collect()
    assert {(r.external_id, r.seq) for r in full} == want and len(full) == len(want)
    assert all(r.note == f"v{r.seq}" and r.lifecycle == 0 for r in full)


def test_current_state_edges(spark):
    schema = "external_id long, seq long, lifecycle int"
    assert state(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 5, 0), (1, 9, 1), (2, 3, 1), (2, 4, 0), (3, 8, 1), (4, 1, 2), (5, 6, 0), (5, 7, 2), (6, 2, 0), (6, 2, 0)]
    got = sorted(tuple(r) for r in state(spark.createDataFrame(rows, schema)).collect())
    assert got == [(2, 4), (5, 6), (6, 2)]


def test_acknowledged_by_any_copy(spark):
    base = spark.createDataFrame([(1, 1, 0, "t"), (2, 2, 0, "t")], "external_id long, seq long, lifecycle int, text string")
    rows = [(10, 1, 1, None, "a", None, ""), (11, 2, 2, 50, None, None, ""), (11, 2, 0, None, "a", None, ""), (12, 3, 0, None, None, None, ""), (4, 9, 0, 20, None, None, "")]
    every = changes.acknowledged_changes(base, spark.createDataFrame(rows, ENTRY))
    assert sorted(tuple(r) for r in state(every).collect()) == [(1, 1), (2, 11), (9, 4)]


def test_live_view_lookups(spark):
    rows = [(1, 1, "upsert", "a"), (1, 5, "delete", None), (1, 7, "upsert", "b"), (2, 2, "upsert", "c"), (2, 3, "delete", None), (3, 4, "upsert", None), (None, 9, "upsert", "x"), (4, 8, None, "y")]
    df = spark.createDataFrame(rows, "id long, seq long, op string, v string")
    live = liveview.live_view(df, "id", "seq", F.col("op") == "upsert")
    assert sorted((r.id, r.seq, r.v) for r in live.collect()) == [(1, 7, "b"), (3, 4, None)]
    assert live.columns == df.columns
    assert [(r.pos, r.id, r.v) for r in liveview.batch_get(live, "id", [3, 2, 1, 1]).collect()] == [(0, 3, None), (1, 2, None), (2, 1, "b"), (3, 1, "b")]
    assert liveview.batch_get(live, "id", []).count() == 0
    assert liveview.point_get(live, "id", 1).count() == 1
    want = spark.createDataFrame([(1,), (2,), (2,), (77,)], "id long")
    assert sorted(r.id for r in liveview.unknown_keys(want, live, "id").collect()) == [2, 77]
    assert [r.id for r in liveview.shadowed(df.where("seq = 2 or seq = 4"), df.where("seq = 3"), "id").collect()] == [3]
    assert liveview.live_view(df.limit(0), "id", "seq", F.col("op") == "upsert").count() == 0


MANIFEST = "generation long, checkpoint_seq long, segments array<string>, status string"


def test_uncovered(spark):
    manifests = spark.createDataFrame([(1, 5, ["a"], "published"), (2, 10, ["a", "b"], "published"), (3, 99, ["a", "b", "c"], "corrupt"), (None, 1, [], "published"), (2, 9, ["a"], "published")], MANIFEST)
    m = incremental.last_good_manifest(manifests)
    assert tuple(m.first()) == (2, 10, ["a", "b"])
    rows = [
        (3, 1, 0, 4, "a", None, ""), (4, 1, 0, 4, None, None, ""), (5, 2, 0, 6, "c", None, ""), (5, 2, 2, None, "b", None, ""), (6, 2, 1, 8, "c", None, ""),
        (6, 2, 1, 8, "c", None, ""), (7, 3, 0, None, None, None, ""), (11, 4, 0, 12, "a", None, ""), (12, 4, 0, None, "a", None, ""), (13, 5, 2, None, None, None, ""), (13, 5, 0, 14, None, None, ""),
    ]
    entries = spark.createDataFrame(rows, ENTRY)
    segments = m.select(F.explode("segments"))
    due = incremental.uncovered(entries, 10, segments, columns=["lifecycle", "segment", "extra"])
    assert sorted((r.seq, r.external_id, r.lifecycle, r._first) for r in due.collect()) == [(4, 1, 0, 4), (6, 2, 1, 8), (11, 4, 0, 12), (13, 5, 0, 14)]
    assert due.columns == ["seq", "external_id", "lifecycle", "segment", "extra", "_first"]
    assert sorted(r.seq for r in incremental.uncovered(entries, None, segments).collect()) == [3, 4, 5, 6, 11, 13]
    none = incremental.last_good_manifest(manifests.where("status = 'staged'"))
    assert none.count() == 0
    assert sorted(r.seq for r in incremental.uncovered(entries, None, None).collect()) == [3, 4, 5, 6, 11, 13]
    assert incremental.uncovered(entries.limit(0), 10, segments).count() == 0


def test_a_run_that_starts_from_a_manifest(spark, tmp_path):
    m = spark.createDataFrame([(2, 10, ["a", "b"])], "generation long, checkpoint_seq long, segments array<string>")
    rows = [(4, 1, 0, 4, "a", None, ""), (5, 1, 0, 4, None, None, ""), (11, 2, 0, 12, "a", None, ""), (12, 3, 0, None, "a", None, ""), (None, 4, 0, 3, None, None, "")]
    for name, manifest, want in (("some", m, [5, 11]), ("none", m.limit(0), [4, 5, 11])):
        run = IncrementalRun(spark, str(tmp_path / name), key=("seq", "external_id"))
        run.start_from(manifest)
        assert run.run(spark.createDataFrame(rows, ENTRY), lambda df: df) == 1
        assert sorted(r.seq for r in run.result().collect()) == want
        again = spark.createDataFrame([*rows, (4, 1, 2, 20, None, None, ""), (12, 3, 0, 9, None, None, "")], ENTRY)
        assert run.run(again, lambda df: df, columns=["seq"]) == 2
        assert sorted(r.seq for r in run.result().collect()) == sorted([*want, 12])  # 4 is covered or done, whatever copies come
        with pytest.raises(StorageError):
            run.start_from(manifest)


def test_copies_and_late_entries_of_later_runs(spark, tmp_path):
    def source(*rows):
        return spark.createDataFrame([(s, s, 0, c, None, "t", "") for s, c in rows], ENTRY)

    for lateness in (None, 5):
        run = IncrementalRun(spark, str(tmp_path / f"l{lateness}"), lateness=lateness)
        job = lambda df: df.select("seq")
        first = [(1, 100), (2, 100), (1, 100), (3, None)]
        assert run.run(source(*first), job) == 1
        later = [*first, (1, 101), (4, 99), (5, 103)]
        assert run.run(source(*later), job) == 2 and run.state()["watermark"] == 103
        assert run.run(source(*later), job) == 0
        far = [*later, (6, 140), (5, 104), (3, 139)]
        assert run.run(source(*far), job) == 3
        assert sorted(r.seq for r in run.result().collect()) == [1, 2, 3, 4, 5, 6]
        assert run.run(source(*far, (7, 200)), job) == 4 and run.state()["oldest"] == (1 if lateness is None else 4)
    with pytest.raises(SchemaError):
        IncrementalRun(spark, str(tmp_path / "x"), lateness=-1)


def test_change_files(spark, tmp_path):
    rng = random.Random(9)
    rows = [(1 if rng.random() < 0.4 else rng.randrange(2, 40), s, rng.choice([0, 0, 1, 2, None])) for s in range(300)] + [(None, 5, 0), (7, None, 0)]
    want, files = brute(rows), changes.ChangeFiles(spark, str(tmp_path / "t"), "external_id", "seq", ["note"])
    with pytest.raises(StorageError):
        files.read()
    rng.shuffle(rows)
    kinds = dict(is_insert=F.col("lifecycle") == 0, is_delete=F.col("lifecycle") == 1)
    for lo in range(0, 310, 80):  # out of order over batches, some rows twice
        part = rows[max(0, lo - 20) : lo + 80]
        files.append(spark.createDataFrame([(*r, f"v{r[1]}", 1) for r in part], "external_id long, seq long, lifecycle int, note string, _kind int"), **kinds)
        if lo == 160:
            files.compact()
    files.append(spark.createDataFrame([], "external_id long, seq long, lifecycle int, note string"), **kinds)
    assert {(r.external_id, r.seq) for r in files.read().collect()} == want
    assert [f for f in files.files_of("delete").columns] == ["external_id", "seq"]
    files.compact()
    got = changes.ChangeFiles(spark, str(tmp_path / "t"), "external_id", "seq", ["note"]).read().collect()
    assert {(r.external_id, r.seq) for r in got} == want and len(got) == len(want) and all(r.note == f"v{r.seq}" for r in got)
    assert len(files.batches()) == 1
    with pytest.raises(SchemaError):
        files.append(spark.createDataFrame([(1,)], "external_id long"), **kinds)
    (tmp_path / "t" / "FILES.json").write_text("{")
    with pytest.raises(StorageError):
        files.batches()


def test_incremental_runs_lose_and_repeat_nothing(spark, tmp_path):
    def feed(lo, hi):
        return [(s, s % 5, 0, None if s % 7 == 0 else s, None, "t", "") for s in range(lo, hi)]

    run = IncrementalRun(spark, str(tmp_path / "job"))
    job = lambda df: df.select("seq", "commit_seq")
    with pytest.raises(StorageError):
        run.result()
    source = spark.createDataFrame(feed(0, 20), ENTRY)
    assert run.run(source, job) == 1

    more = source.unionByName(spark.createDataFrame(feed(20, 50), ENTRY))

    def crash():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run.run(more, job, before_publish=crash)
    assert run.state()["watermark"] == 19  # nothing of the failed run shows
    assert run.result().count() == 17
    assert IncrementalRun(spark, str(tmp_path / "job")).run(more, job) == 2
    assert run.run(more, job) == 0
    seqs = sorted(r.seq for r in run.result().collect())
    assert seqs == [s for s in range(50) if s % 7]
    assert run.run(source.limit(0), job) == 0
    with pytest.raises(SchemaError):
        run.run(source.drop("commit_seq"), job)
    (tmp_path / "job" / "WATERMARK.json").write_text("{")
    with pytest.raises(StorageError):
        run.state()


def test_upper_limit_is_fixed_at_the_start(spark, tmp_path):
    run = IncrementalRun(spark, str(tmp_path / "job"))
    path = str(tmp_path / "source")
    spark.createDataFrame([(1, 1), (2, 2)], "seq long, commit_seq long").write.parquet(path)
    rows, high = run.pending(spark.read.parquet(path))
    spark.createDataFrame([(3, 3)], "seq long, commit_seq long").write.mode("append").parquet(path)
    assert high == 2 and rows.agg(F.max("commit_seq")).first()[0] == 2
    assert run.state() == {"watermark": None, "run": 0, "oldest": 1, "base": None}
    assert run.run(spark.read.parquet(path), lambda df: df) == 1
    assert sorted(tuple(r) for r in run.result().collect()) == [(1, 1), (2, 2), (3, 3)]

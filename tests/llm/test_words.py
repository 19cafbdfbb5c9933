"""Distinctive terms and frequencies against plain Python."""

import math
from collections import Counter

import pytest
from quernstone.llm import distinctive
from quernstone.llm.distinctive import term_weights, top_terms
from quernstone.llm.frequency import term_frequencies

ROWS = [(1, "Alpha beta beta, gamma!"), (2, "alpha"), (3, None), (4, ""), (5, "... !"), (6, "delta ALPHA eps_zeta " * 50), (1, "Alpha beta beta, gamma!"), (None, "lost"), (7, "beta alpha"), (8, "ΟΔΟΣ x2 日本")]
SCHEMA = "external_id long, text string, term string, df long, weight double, id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 1.0, 2) for i, t in rows], SCHEMA).repartition(3)


def counted(rows):
    import re

    return {i: Counter(w.replace("Σ", "σ").lower() for w in re.findall(r"[^\W_]+", t or "")) for i, t in rows if i is not None}


def brute(rows, weight, a=0.75):
    docs = counted(rows)
    n, cf, df = len(docs), Counter(), Counter()
    for c in docs.values():
        cf.update(c)
        df.update(c.keys())
    words, smooth = sum(cf.values()), sum(v**a for v in cf.values())
    out = {}
    for i, c in docs.items():
        dl = sum(c.values())
        for t, tf in c.items():
            if weight == "ppmi":
                w = max(0.0, math.log((tf / words) / ((dl / words) * (cf[t] ** a / smooth))))
            else:
                w = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / max(words / n, 1.0)))
            out[i, t] = (tf, w)
    return out


@pytest.mark.parametrize("weight", ["ppmi", "bm25"])
@pytest.mark.parametrize("limit", [8 << 20, 200, 10])
def test_weights(spark, monkeypatch, weight, limit):
    if limit < 1000:  # as if the counts, or those of the hot terms too, were too large to broadcast
        monkeypatch.setattr(distinctive, "BROADCAST_TERMS", limit)
        monkeypatch.setattr(distinctive, "HOT_SHARE", 6)
    want = brute(ROWS, weight)
    got = term_weights(frame(spark, ROWS), weight=weight).collect()
    assert len(got) == len(want)
    for r in got:
        tf, w = want[r.external_id, r.term]
        assert r.tf == tf and abs(r.weight - w) < 1e-12


def test_top_terms_and_ties(spark):
    rows = [(1, "b a c d"), (2, "z")]
    top = top_terms(term_weights(frame(spark, rows), weight="bm25"), 3)
    assert sorted((r.external_id, r["rank"], r.term) for r in top.collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "z")]


def test_empty_and_arguments(spark):
    assert term_weights(frame(spark, [])).count() == 0 and term_weights(frame(spark, [(1, None)])).count() == 0
    assert term_frequencies(frame(spark, [])).count() == 0 and term_frequencies(frame(spark, [(1, "")])).count() == 0
    for bad in (dict(weight="tf"), dict(smoothing=0)):
        with pytest.raises(ValueError):
            term_weights(frame(spark, []), **bad)
    with pytest.raises(ValueError):
        term_frequencies(frame(spark, []), rare_below=-1)


def test_frequencies(spark):
    docs = counted(ROWS)
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_frequencies(frame(spark, ROWS), rare_below=2, common_share=0.4).collect()}
    cf, df = Counter(), Counter()
    for c in docs.values():
        cf.update(c)
        df.update(c.keys())
    n = len(docs)
    assert got == {t: (cf[t], df[t], "rare" if df[t] < 2 else "common" if df[t] > 0.4 * n else None) for t in cf}


def test_frequencies_of_a_hot_term_and_small_batches(spark):
    rows = [(i, "hot hot w%d" % (i % 7)) for i in range(500)] + [(1000, "long " * 20_000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {r.term: (r.occurrences, r.records) for r in term_frequencies(frame(spark, rows)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["hot"] == (1000, 500) and got["long"] == (20_000, 1) and got["w0"] == (72, 72)


def test_few_terms_held_at_once(spark):
    rows = [(i % 60, " ".join(f"w{(i * j) % 37}" for j in range(12)) + " all") for i in range(120)]
    rows += rows[:30]
    want = {r.term: (r.occurrences, r.records) for r in term_frequencies(frame(spark, rows)).collect()}
    assert want["all"][1] == 60
    assert {r.term: (r.occurrences, r.records) for r in term_frequencies(frame(spark, rows), held=1).collect()} == want


@pytest.mark.parametrize("batch", [1, 2, 10_000])
def test_an_id_with_several_texts_is_one_record_of_a_term(spark, batch):
    rows = [(i % 40, f"alpha beta{i % 3} {'alpha ' * (i % 4)}v{i}") for i in range(200)]
    cf, holders = Counter(), {}
    for i, t in set(rows):
        for w in t.split():
            cf[w] += 1
            holders.setdefault(w, set()).add(i)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.term: (r.occurrences, r.records) for r in term_frequencies(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {w: (cf[w], len(holders[w])) for w in cf}

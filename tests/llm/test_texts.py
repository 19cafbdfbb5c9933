"""Encoding, leaked passages and spam pages."""

import base64
import random
import re

import numpy as np
import pytest
from quernstone.llm import leaks, spam
from quernstone.llm.encode import Encoder, Vocabulary, encode
from quernstone.llm.leaks import leaked_items

P = pytest.importorskip("public_tokenizers")
TEXTS = [
    None, "", " ", "Hello, world!", "it's  we'll\n\n\tdon't", "Größe ½ ² 日本語 👍👩‍👩‍👧", "<|endoftext|> <|endoftext|>", "a" * 5000, "ab" * 3000 + "!" * 200, " " * 300, "\x00\x01�", "1234567890" * 30,
    "x" * 47, "x" * 48, "x" * 49, "antidisestablishmentarianism" * 4,
]


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoding_equals_the_public_library(spark, public):
    rng = random.Random(3)
    letters = "abcdeéß日 🙂.,'\n\t0123ABC"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(None, "x", None), (0, None, None)], "doc_id long, text string, ids array<int>").repartition(3)
    rows = encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, batch=17).collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: r.ids for r in rows if r.doc_id is not None}
    assert [got[i] for i in range(len(texts))] == public(texts)
    assert got[0] == [] and got[1] == []
    assert encode(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_encoding_of_another_vocabulary_and_forgetting(public):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    e = Encoder(Vocabulary.load(path), P.PATTERN, remembered=3)
    for text in ("Größenwahn und Übermut", "naïve café", "x" * 100, "Größenwahn"):
        ids, sizes = e.encode([text, None])
        assert ids.tolist() == reference.encode_ordinary(text) and sizes.tolist() == [len(ids), 0]


def test_long_and_short_merging_agree():
    v = Vocabulary.load(P.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(9)
    pieces = [bytes(rng.choice(b"abcest ") for _ in range(rng.randrange(1, 48))) for _ in range(300)]
    assert v.merge_short(pieces) == [v.merge_long(p) for p in pieces]
    spelled = {r: t for t, r in v.ranks.items()}
    assert all(b"".join(spelled[i] for i in ids) == p for ids, p in zip(v.merge_short(pieces), pieces))  # round trip


# -- leaks ---------------------------------------------------------------------------------------

VOCABULARY = [f"w{i}" for i in range(4000)]


def tokens(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text or "")]


def brute_leaks(docs, items, w=10):
    grams = [({tuple(t[i : i + w]) for i in range(len(t) - w + 1)}, k) for k, x in items for t in [tokens(x)]]
    return {(d, k) for d, x in docs for t in [tokens(x)] for have, k in grams if any(tuple(t[i : i + w]) in have for i in range(len(t) - w + 1))}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: [rng.choice(VOCABULARY) for _ in range(n)]
    items = [(k, " ".join(word(rng.choice([9, 10, 30])))) for k in range(30)]
    docs = []
    for d in range(120):
        body = word(rng.randrange(0, 80))
        if rng.random() < 0.4:
            src = tokens(rng.choice(items)[1])
            n = rng.choice([9, 10, 11, 20])
            at = rng.randrange(max(1, len(src) - n + 1))
            body[len(body) // 2 : len(body) // 2] = src[at : at + n]
        docs.append((d, rng.choice([" ", ", ", " -- ", "\n"]).join(x.upper() if rng.random() < 0.3 else x for x in body)))
    return docs, items


def pairs(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, item_id long").repartition(4)
    i = spark.createDataFrame([(*r, 8) for r in items], "item_id long, text string, doc_id long")
    got = [tuple(r) for r in leaked_items(d, i, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_leaks_are_exact(spark):
    docs, items = corpus(1)
    dirt = [(500, None), (501, ""), (502, "   "), (None, items[1][1])]
    want = brute_leaks(docs, items)
    assert len(want) > 20
    assert pairs(spark, docs + dirt + docs[:20], items + [(99, None), (None, "x " * 20), (98, ""), items[0]]) == want
    assert pairs(spark, docs, items, passages=60) == want  # items in blocks


def test_leaks_of_nothing(spark):
    docs, items = corpus(2)
    assert pairs(spark, [], items) == set() and pairs(spark, docs, []) == set() and pairs(spark, docs, [(1, "too short")]) == set()
    for bad in (dict(window=0), dict(max_edit=10), dict(target_recall=1.0)):
        with pytest.raises(ValueError):
            pairs(spark, docs, items, **bad)


def test_common_passage_in_a_third_of_the_documents(spark):
    text = " ".join(VOCABULARY[:15])
    docs = [(d, f"x{d} {text} y{d}" if d % 3 == 0 else f"z{d} " * 12) for d in range(90)]
    assert pairs(spark, docs, [(1, text), (2, text + " end")]) == {(d, i) for d in range(0, 90, 3) for i in (1, 2)}


def test_near_leaks_reach_the_recall(spark):
    rng = random.Random(4)
    items = [(k, " ".join(rng.choice(VOCABULARY) for _ in range(10))) for k in range(150)]
    docs = []
    for k, text in items:
        w = text.split()
        at = rng.randrange(1, 9)
        kind = rng.randrange(3)
        w = w[:at] + (["new"] if kind == 0 else ["new", w[at]] if kind == 1 else []) + w[at + 1 :]
        docs.append((k, "left " * 3 + " ".join(w) + " right" * 3))
    got = pairs(spark, docs, items, max_edit=1)
    assert len(got & {(k, k) for k, _ in items}) >= 0.9 * len(items)
    assert all(a == b for a, b in got)


def test_edit_distances():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (2, 200, 7))
    assert leaks.edit_distances(a, b).tolist() == [plain(x, y) for x, y in zip(a.tolist(), b.tolist())]
    c = rng.integers(0, 3, (200, 9))
    assert leaks.edit_distances(a, c, 2).tolist() == [min(plain(x, y[:n]) for n in range(5, 10)) for x, y in zip(a.tolist(), c.tolist())]


def test_equal_windows_have_equal_keys():
    h = np.random.default_rng(2).integers(1, 2**62, 40).astype(np.uint64)
    twice = np.concatenate((h, h))
    first, second = (leaks.walk_keys(twice, at, at + 10, 10, 0, 1) for at in (np.arange(30), np.arange(40, 70)))
    assert (first == second).all() and len(set(first.tolist())) > 10
    assert leaks.simulated_hits(10, 1, 0, 1).mean() > leaks.simulated_hits(10, 3, 0, 1).mean()
    assert leaks.tables_for(10, 0, 0.99) == 1 < leaks.tables_for(10, 1, 0.8) < leaks.tables_for(10, 1, 0.95)


# -- spam ----------------------------------------------------------------------------------------

SUBJECT = ["The reader", "A writer", "Our team", "Every shard", "The older note", "Nobody here", "This index", "The night shift"]
VERB = ["keeps", "compared", "dropped", "explains", "measured", "rebuilt", "opened", "ignores"]
OBJECT = ["a snapshot of the log", "the filter before the merge", "some rows without a vector", "what was written on Monday", "its own copy of the key", "the queue behind the lock", "two of the slow runs", "the count that we had expected"]


NAMES = ["".join(random.Random(i * 7 + j).choice("bdfgklmnprstvz") + random.Random(i * 11 + j).choice("aeiou") for j in range(2 + i % 3)) for i in range(800)]


def ordinary(rng, n):
    """Sentences with words of a long tail, as the estimate takes its scatter from the texts themselves:
    where all of them are made of two dozen phrases, a list of keywords is nothing unusual."""
    name = lambda: rng.choice(NAMES)
    return [f"{rng.choice(SUBJECT)} of {name()} {rng.choice(VERB)} {rng.choice(OBJECT)} for {name()} in {rng.choice(VOCABULARY)} and {name()} with {name()}." for _ in range(n)]


def spam_lines(rng, kind, n):
    keys = [f"{a} {b}" for a in ("cheap", "best", "free") for b in ("index", "store")]
    if kind == 0:
        return [", ".join(rng.choice(keys) for _ in range(12)) for _ in range(n)]
    if kind == 1:
        return [f"- http://{rng.choice(VOCABULARY)}.example/{rng.choice(VOCABULARY)}" for _ in range(n)]
    if kind == 2:
        return [f"{rng.choice(VOCABULARY).upper()}AB-{rng.randrange(999)} XL {rng.choice(keys)} {rng.randrange(99)}.50 EUR" for _ in range(n)]
    return [" ".join(f"#{rng.choice(keys).replace(' ', '')}" for _ in range(8)) for _ in range(n)]


def made_pages(rng, ordinary, n, noise=0.0):
    docs, want = [], set()
    for d in range(n):
        lines = ordinary(rng, rng.randrange(6, 14))
        if d % 10 == 1:
            lines = ordinary(rng, 2) + spam_lines(rng, d // 10 % 4, 18)
            want.add(d)
        elif d % 10 == 2:
            lines = ordinary(rng, 16) + spam_lines(rng, d // 10 % 4, 2)
        elif d % 10 == 3:
            lines = ordinary(rng, 6) + ["| run | rows | recall |"] + [f"| {rng.choice(VOCABULARY)} | {rng.randrange(9999)} | 0.{rng.randrange(999)} |" for _ in range(5)]
        elif d % 10 == 4:
            lines = [f"http://{rng.choice(VOCABULARY)}.example/a {x}" for x in ordinary(rng, 8)]
        docs.append((d, "\n".join(lines), "en", "x"))
    return docs, want


def invented(seed):
    """Sentences of a language that nobody speaks: its own function words among words of a long tail."""
    rng = random.Random(seed)
    syllable = lambda: rng.choice("bdfgklmnprstvz") + rng.choice("aeiou")
    small = [syllable() + rng.choice(["", "n", "s"]) for _ in range(25)]
    long_tail = ["".join(syllable() for _ in range(rng.randrange(2, 5))) for _ in range(3000)]

    def sentences(rng, n):
        return [" ".join(rng.choice(small) if rng.random() < 0.45 else rng.choice(long_tail) for _ in range(rng.randrange(8, 18))).capitalize() + "." for _ in range(n)]

    return sentences


def test_spam_pages(spark):
    docs, want = made_pages(random.Random(6), ordinary, 400)
    docs += [(900, None, "en", "x"), (901, "", None, None), (902, " \n\t", "xx", "x"), (903, "word", None, "x"), (None, "cheap cheap", "en", "x"), docs[1], (904, "\ue000 12 34", "en", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, features string").repartition(4)
    got = {r.doc_id: r.spam_share for r in spam.spam_shares(df).collect()}
    assert set(got) == {r[0] for r in docs if r[0] is not None} and got[900] == got[901] == got[902] == 0.0
    flagged = {r.doc_id for r in spam.spam_documents(df).collect()}
    assert len(flagged & want) >= 0.95 * len(want) and len(flagged - want) <= 4
    assert spam.spam_documents(df.limit(0)).count() == 0 and spam.spam_documents(df.where("text is null")).count() == 0
    for bad in (dict(cutoff=0), dict(directed=2)):
        with pytest.raises(ValueError):
            spam.spam_shares(df, **bad)


def test_spam_pages_of_an_invented_language(spark):
    docs, want = made_pages(random.Random(7), invented(3), 600)
    df = spark.createDataFrame([(d, t, "qq-ZZ", x) for d, t, _, x in docs], "doc_id long, text string, lang string, features string").repartition(4)
    assert {r.lang for r in spam.spam_shares(df).collect()} == {"qq"}
    flagged = {r.doc_id for r in spam.spam_documents(df).collect()}
    assert len(flagged & want) >= 0.9 * len(want) and len(flagged & want) >= 0.9 * len(flagged)


def test_function_words_come_from_the_texts(spark):
    rng = random.Random(8)
    docs = [(d, " ".join(ordinary(rng, 5)), "en") for d in range(60)] + [(d, " ".join(invented(3)(rng, 5)), "qq") for d in range(60, 120)]
    docs += [(d, "stuffed " * 40 + "the in and", "en") for d in range(120, 130)]
    lexicon = spam.lexicon_of(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    english = {w for w, b in lexicon.bits.items() if b & 1}
    assert lexicon.languages == ["en", "qq"] and {"the", "in", "and"} <= english and "stuffed" not in english
    read = spam.Reader(lexicon).read([docs[0][1], docs[70][1], docs[70][1], "12 34", None], ["en", "qq", "en", "xx", "en"])
    assert read.lang.tolist() == [0, 1, 1, -1, 0]


def test_a_robust_fit_ignores_a_fifth_of_outliers():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.multivariate_normal([3, 2, 0.9, 1.5], np.diag([0.25, 0.16, 0.04, 0.01]), 4800), rng.multivariate_normal([7, 5, 0.1, 2.4], np.diag([0.1, 0.1, 0.01, 0.01]), 1200)))
    p = spam.Passages(np.zeros(6000, np.int64), np.arange(6000), np.ones(6000), np.ones(6000), x)
    keys, sums = spam.cells_of(p)
    fit = spam.fits_of(keys, sums, 1)[0]
    assert np.abs(fit.centre - [3, 2, 0.9, 1.5]).max() < 0.1 and np.abs(np.sqrt(np.diag(fit.scatter)) / [0.5, 0.4, 0.2, 0.1] - 1).max() < 0.35
    assert len(keys) < 6000 and abs(sums[:, 0].sum() - 6000) < 1e-6


def test_passages():
    text = "<p>One line.</p><ul><li><a href='http://a.example/x'>label</a></li></ul>\n" + "A sentence here. " * 12
    parts = spam.passages(text)
    assert parts[0] == "One line." and parts[1].startswith("http://a.example/x") and len(parts) == 14
    assert [spam.code_of(x) for x in (" FR-xx", "en", "deutsch", None, "")] == ["fr", "en", "", "", ""]
    read = spam.Reader(spam.Lexicon({})).read(["buy " * 20_000, "", None], [None] * 3)
    assert len(read.chars) == 1 and (read.x[0, 0] ** 2 - 0.375) / spam.WINDOW > 0.95 and read.lang.tolist() == [-1] * 3

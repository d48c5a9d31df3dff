"""URL cascade, language model, quality classifier, quotation links and license scans, with edge cases."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from tessera.llm import fm_quality, gru, language_model, licenses, quotes, url_cascade

WORDS = [a + b for a in "bcdfghlmnprst" for b in ("an", "et", "ix", "ol", "um", "ara", "eno")]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"host{i}.example/" for i in range(3000)]
    listed = keys[::37]
    cascade = url_cascade.build(spark.createDataFrame([(k,) for k in [*keys, keys[0]]] + [(None,)], "k string"), listed)
    assert cascade.listed(keys).tolist() == [k in set(listed) for k in keys]
    assert len(cascade.levels) >= 2 and cascade.size_bytes < 20 * len(listed)
    assert url_cascade.build(spark.createDataFrame([("a",)], "k string"), []).listed(["a"]).tolist() == [False]
    assert url_cascade.build(spark.createDataFrame([], "k string"), ["a"]).listed(["a"]).tolist() == [True]


def test_url_rules(spark):
    cases = [
        ("http://a.net/x", "net/", "block"), ("HTTPS://Sub.Example.NET/en/1?q", "example.net/en/", "allow"), ("http://example.net/e", "net/", "block"),
        ("http://notexample.com/de/", None, "allow"), ("http://x.example.com/de/1#a", "example.com/de/", "block"), ("http://example.com/DE/", None, "allow"),
        ("http://k.org/fr/", "org/fr/", "allow"), ("http://a.net", None, "allow"), ("http://a.net?x=/", None, "allow"), ("http://a.net:80/", None, "allow"), ("no scheme", None, "allow"), (None, None, "allow"), ("://net/", "net/", "block"), ("", None, "allow"), ("http://net/", "net/", "block"),
    ]
    df = spark.createDataFrame([(i, u, "clash", 1.5) for i, (u, *_) in enumerate(cases)], "page_id int, url string, rule string, x double")
    got = {r.page_id: r for r in url_cascade.judge(df, url_cascade.PRODUCTION_RULES).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(len(cases))] == [c[1:] for c in cases]
    assert (got[1].host, got[1].path, got[1].x) == ("sub.example.net", "/en/1", 1.5) and (got[8].host, got[8].path) == ("a.net", "")
    assert url_cascade.judge(df.limit(0), url_cascade.PRODUCTION_RULES).collect() == []
    assert {r.verdict for r in url_cascade.judge(df, []).collect()} == {"allow"}
    with pytest.raises(ValueError):
        url_cascade.judge(df, [url_cascade.UrlRule("allow", "a"), url_cascade.UrlRule("block", "a")])


def brute_state(p, h, x):
    sig = lambda v: 1 / (1 + np.exp(-v))
    z, c = sig(p["E"][x] @ p["Wz"] + p["bz"] + p["uz"] * h), np.tanh(p["E"][x] @ p["Wn"] + p["bn"] + p["un"] * h)
    return z * h + (1 - z) * c


def brute_log(p, shape, h, t):
    logits = h @ p["Wc"] + p["bc"]
    k = int(shape.class_of[t])
    total = logits[k] - np.log(np.exp(logits).sum())
    if k < shape.classes:
        a, b = shape.bounds[k], shape.bounds[k + 1]
        inner = p["Ww"][a:b, :-1] @ h + p["Ww"][a:b, -1]
        total += inner[t - a] - np.log(np.exp(inner - inner.max()).sum()) - inner.max()
    return total


def brute_probability(p, shape, doc, bos):
    h, x, total = np.zeros(shape.hidden), bos, 0.0
    for t in doc:
        h = brute_state(p, h, x)
        total += brute_log(p, shape, h, t)
        x = t
    return total / math.log(10)


def small_model():
    shape = gru.Shape((0, 1, 4, 6, 10), tails=2, embed=3, hidden=5)
    p = gru.start(shape, np.arange(12, 0, -1))
    rng = np.random.default_rng(0)
    for k in ("Wc", "Ww", "E", "Wz", "Wn", "uz", "un"):
        p[k] = (rng.standard_normal(p[k].shape) * 0.7).astype(np.float32)
    return shape, p


def test_scores_do_not_depend_on_windows_or_lanes():
    shape, p = small_model()
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 12, n) for n in (1, 3, 50, 7, 200, 2)]
    want = [brute_probability(p, shape, d, 0) for d in docs]
    for width, window in ((1, 7), (3, 16), (64, 1000)):
        each = gru.token_log10(p, shape, docs, 0, width, window)
        assert np.allclose(np.add.reduceat(each, np.r_[0, np.cumsum([len(d) for d in docs])[:-1]]), want, atol=1e-3)


def test_probabilities_sum_to_one():
    shape, p = small_model()
    assert sum(10 ** gru.token_log10(p, shape, [np.array([5, t])], 0)[1] for t in range(12)) == pytest.approx(1, abs=1e-5)


def test_classes_cover_all_words():
    for n, classes in ((1, 1), (1, 4), (5, 3), (1000, 20)):
        bounds = gru.bounds_of(np.sort(np.random.default_rng(n).zipf(1.5, n))[::-1].astype(float), classes)
        assert bounds[0] == 0 and bounds[-1] == n and len(bounds) <= classes + 1
        assert all(a < b for a, b in zip(bounds, bounds[1:], strict=False))


def test_gradient():
    shape, p = small_model()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 12, (6, 2)), rng.integers(0, 12, (6, 2))
    keep = np.ones((6, 2))
    keep[0], keep[3, 1] = 0, 0

    def loss():
        total = 0.0
        for lane in range(2):
            h = np.zeros(shape.hidden)
            for t in range(6):
                h = brute_state(p, h * keep[t, lane], x[t, lane])
                total -= brute_log(p, shape, h, y[t, lane])
        return total / 12

    def slope(name, at):
        old, eps = p[name][at], 1e-5
        p[name][at] = old + eps
        up = loss()
        p[name][at] = old - eps
        down = loss()
        p[name][at] = old
        return (up - down) / (2 * eps)

    trainer = gru.Trainer(p, shape, word_rate=1.0)
    e, before, z, c, after = gru._run(p, x, keep, np.zeros((2, shape.hidden)))
    s, target = after.reshape(-1, shape.hidden), y.ravel()
    ds, grad = trainer._classes(s, shape.class_of[target], np.full(12, 1 / 12))
    trainer._words(s, shape.class_of[target], target, ds, 1 / 12)
    grad |= trainer._backward(x, keep, e, before, z, c, ds.reshape(before.shape))
    for name in trainer.DENSE:
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in p[name].shape)
            assert grad[name][at] == pytest.approx(slope(name, at), abs=1e-5), name
    # rows of words move against their gradient, by its root mean square
    for k in np.unique(x):
        g = np.array([slope("E", (k, j)) for j in range(shape.embed)])
        assert trainer.p["E"][k] - p["E"][k] == pytest.approx(-g / np.sqrt(1e-8 + np.mean(g * g)), abs=1e-3)
    g = np.array([[slope("Ww", (w, j)) for j in range(shape.hidden + 1)] for w in range(1, 4)])
    seen = 1e-8 + np.mean(g[:, :-1] ** 2, axis=1)
    step = 1 / np.sqrt(np.maximum(seen, seen.mean()))
    assert trainer.p["Ww"][1:4] - p["Ww"][1:4] == pytest.approx(-step[:, None] * g, abs=1e-3)


@pytest.mark.parametrize("known", [5, 120_000])
def test_language_model(spark, monkeypatch, known):
    monkeypatch.setattr(language_model, "KNOWN", known)
    rng = random.Random(4)
    halves = [WORDS[:40], WORDS[40:]]
    texts = [prose(rng, rng.randint(20, 80), halves[i % 2]) for i in range(240)] + [None, "", "Unseen" + "x" * 3000, "two\twords"] + ["same text"] * 2
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "again"), (None, "bix cet", "null key")]
    got = language_model.held_out_scores(spark.createDataFrame(rows, "doc_id long, text string, score string")).collect()
    tokens = [(t or "").lower().split() + [""] for _, t, _ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows]
    counts = collections.Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for (i, *_), ws, h in zip(rows, tokens, held, strict=True):
        want[(i, h, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6))] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize(("sf", "margin"), [("sf0.001", 0.005), ("sf0.01", 0.03)])
def test_language_model_beats_counts_whatever_the_partitions(spark, sf, margin):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    seen = []
    for n in (1, 7, 64) if sf == "sf0.001" else (7,):
        r = language_model.held_out_scores(docs.repartition(n)).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
        seen.append(r["sum(score)"])
        assert r["sum(score)"] > (1 - margin) * r["sum(base_score)"]
    assert max(seen) == pytest.approx(min(seen), rel=1e-6)


def test_shards_and_vocabulary_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD", 100)
    monkeypatch.setattr(language_model, "SHARD_BY_PARAMETER", 0)
    rng = random.Random(5)
    heads = []
    for n in (10, 80):
        docs = spark.createDataFrame([(i, prose(rng, 30)) for i in range(n)], "doc_id long, text string")
        model = language_model.untrained(language_model.vocabulary_of(language_model.count_words(docs)))
        assert language_model.shards_of(model) == max(1, round(n * 31 / 300))
        heads.append(math.ceil(language_model.WORDS * model.vocabulary.tokens ** (1 / 3)))
    assert heads[1] == pytest.approx(2 * heads[0], rel=0.02)


def test_every_training_document_trains_the_recurrent_part_once(spark, monkeypatch):
    seen, average = [], language_model._averaged

    def spy(copies, like):
        seen.append(copies.filter("seg = 0").agg({"weight": "sum"}).first()[0] or 0)
        return average(copies, like)

    monkeypatch.setattr(language_model, "_averaged", spy)
    rows = [(i, f"bix cet {i}") for i in range(60)] + [(None, "null key"), (None, None)] + [(7, "again")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = language_model.fit(docs, language_model.count_words(docs))
    assert len(seen) == language_model.ROUNDS
    assert sum(seen) == model.vocabulary.tokens == 60 * 4 + 3 + 1 + 18
    assert min(seen) > 0


def test_language_model_of_nothing(spark):
    assert language_model.held_out_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_factorisation_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = fm_quality.Machine(0.3, rng.standard_normal(20), rng.standard_normal((20, 4)))
    at, x = np.array([1, 4, 7, 19]), rng.standard_normal(4)
    pairs = sum((m.v[at[i]] @ m.v[at[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.margin(at, x) == pytest.approx(0.3 + m.w[at] @ x + pairs)


def test_quality(spark):
    rng = random.Random(5)
    good = [prose(rng, rng.randint(40, 90)) + "." for _ in range(150)]
    junk = [" ".join(w + "###" for w in prose(rng, 50).split()) for _ in range(60)]
    texts = [*good, *junk, None, "", "x" * 5000]
    docs = spark.createDataFrame([(i, t, None if i % 7 == 0 else len(t or ""), "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)] + [(None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in fm_quality.held_out_quality(docs, labels).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    test = [r for r in got.values() if r.held_out and r.doc_id < 210]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    assert sum(r.predicted == int(r.doc_id < 150) for r in test) >= 0.95 * len(test)
    none = fm_quality.held_out_quality(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert fm_quality.held_out_quality(docs.limit(0), labels).collect() == []


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"word{i % 2} text {i}") for i in range(80)], "doc_id long, text string")
    rows = [(i, i % 2, 0) for i in range(80)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, t) for i, y, t in rows]
    a, b = (sorted((r.doc_id, r.score) for r in fm_quality.held_out_quality(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (rows, flipped))
    assert a == b


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there, this is the start.\nSecond line of it.", "clash"),
        (1, 1, "assistant", "On Monday X wrote:\n> Hello there, this is\n> the start.\nI agree with you.", "clash"),
        (1, 2, "user", "> > Hello there, this is the start.\n> I agree with you.\n\nThanks!\n> never said this", "clash"),
        (1, 3, "user", None, "clash"), (1, 4, "user", "> SECOND   line of it.\nok", "clash"),
        (2, 0, "user", "> Hello there, this is the start.", "clash"), (None, 1, "user", "> a b c", "clash"), (3, 5, "user", "", "clash"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string")).collect()}
    facts = {k: (r.text, r.reply_to, r.thread, r.depth, r.n_quotes, r.n_linked) for k, r in got.items()}
    assert facts[1, 1] == ("I agree with you.", 0, 0, 1, 1, 1)
    assert facts[1, 2] == ("Thanks!", 1, 0, 2, 3, 2) and got[1, 2].unlinked == ["never said this"]
    assert facts[1, 4] == ("ok", 0, 0, 1, 1, 1)
    assert facts[1, 3] == (None, None, 3, 0, 0, 0) and facts[1, 0][1:] == (None, 0, 0, 0, 0) and facts[3, 5][0] == ""
    assert facts[2, 0] == ("", None, 0, 0, 1, 0) and facts[None, 1][1] is None


def test_quotes_without_any(spark):
    df = spark.createDataFrame([(1, 0, "user", "a > b"), (1, 0, "user", "a > b")], "conv_id long, turn long, role string, text string")
    assert [(r.text, r.reply_to, r.thread) for r in quotes.link_quotes(df).collect()] == [("a > b", None, 0)] * 2
    assert quotes.link_quotes(df.limit(0)).collect() == []


def test_long_chain_of_replies(spark):
    rows = [(1, 0, "user", "message number 0 here")] + [(1, n, "user", f"> message number {n - 1} here\nmessage number {n} here") for n in range(1, 40)]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.turn, r.reply_to, r.thread, r.depth) for r in got if r.turn) == [(n, n - 1, 0, n) for n in range(1, 40)]


@pytest.fixture(scope="module")
def classifier():
    return licenses.train()


def test_licenses_found_and_not_found(spark, classifier):
    rng = random.Random(9)
    cases = [
        (f"{prose(rng, 40)}\nReleased under the MIT License.\n{prose(rng, 30)}", ["MIT"]),
        (f"# Licensed under the Apache License, Version 2.0.\n\n{prose(rng, 30)}", ["Apache-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        (f"{prose(rng, 10)}\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.", ["CC-BY-NC", "MIT"]),
        ("Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files, to deal\nin the Software without restriction", ["MIT"]),
        ("The license of the driver expired and permission was not granted.", []), (prose(rng, 3000), []), ("x" * 5000, []), (None, []), ("", []), (" \n\n ", []), ("version 2.0", []),
    ]
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(cases)], "doc_id long, text string, families string")
    got = {r.doc_id: r for r in licenses.scan(df, classifier=classifier).collect()}
    assert [got[i].families for i in range(len(cases))] == [f for _, f in cases]
    s = got[0].spans[0]
    assert cases[0][0][s.start : s.stop] == "Released under the MIT License." and s.confirmation >= licenses.CONFIRM
    assert licenses.scan(df.limit(0), classifier=classifier).collect() == []


def test_license_accuracy_on_drawn_examples(classifier):
    rng = np.random.default_rng(99)
    texts, labels = licenses._examples(rng, 5, 600)
    memo = licenses._Memo()
    sets = [(licenses._hashes(memo, t), y) for t, y in zip(texts, labels, strict=True)]
    sets = [(h, y) for h, y in sets if len(h)]
    p = np.array([classifier.probabilities(h, np.array([[0, len(h)]]))[0] for h, _ in sets])
    y = np.array([y for _, y in sets])
    unknown = len(classifier.families) - 1
    named = np.where((p[:, :-1].max(axis=1) >= classifier.bound) & (p.argmax(axis=1) != unknown), p.argmax(axis=1), unknown)
    assert (named == y)[y != unknown].mean() > 0.9 and (named == y)[y == unknown].mean() > 0.97

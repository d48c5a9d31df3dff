"""The block inverted index against brute force, with small blocks of documents and queries."""

import collections
import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import lexical
from tessera.sources.scratch import written

WORDS = [f"w{i}" for i in range(60)]


def corpus(rng, n):
    skew = lambda: WORDS[min(int(rng.paretovariate(0.7)) - 1, 59)]
    rows = [(i, " ".join(skew() for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "w1 " * 500), (3, "w59 w58"), (3, "w59 w58")]


def brute(docs, queries, k, digits=6, k1=1.2, b=0.75):
    toks = [(key, re.findall(r"\w+", (t or "").lower())) for key, t in docs]
    n, avg = len(toks), sum(len(t) for _, t in toks) / len(toks)
    df = collections.Counter(w for _, t in toks for w in set(t))
    out = []
    for q, text in queries:
        rows = []
        for key, t in toks:
            tf = collections.Counter(t)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / avg)) for w in dict.fromkeys(re.findall(r"\w+", (text or "").lower())) if tf[w])
            if round(s, digits) > 0:
                rows.append((-round(s, digits), key))
        out += [(q, key, i + 1) for i, (_, key) in enumerate(sorted(rows)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("documents", "terms", "parts"), [(8_192, 50_000, 1), (7, 50_000, 3), (16, 9, 2)])
def test_bm25(spark, monkeypatch, documents, terms, parts):
    monkeypatch.setattr(lexical, "QUERY_TERMS", terms)
    rng = random.Random(documents)
    docs = corpus(rng, 120)
    queries = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 8)))) for i in range(20)] + [(90, None), (91, "nowhere"), (92, "w1 nowhere W1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    q = spark.createDataFrame(queries, "item_id long, text string")
    index = written(lexical.build_index(d, documents=documents), "index")
    assert index.filter("term = ''").count() >= len(docs) / documents
    got = sorted((r.item_id, r.doc_id, r["rank"]) for r in lexical.bm25(d, q, 5, index=index).collect())
    assert got == brute(docs, queries, 5)
    assert sorted((r.item_id, r.doc_id, r["rank"]) for r in lexical.bm25(d, q, 5).collect()) == got


def test_shared_terms_of_string_keys(spark):
    d = spark.createDataFrame([("b", "alpha beta beta"), ("a", "beta alpha"), ("c", "beta"), (None, "gamma"), ("d", None)], "doc_id string, text string")
    q = spark.createDataFrame([(1, "alpha beta x"), (2, "gamma"), (3, "")], "item_id long, text string")
    got = [tuple(r) for r in lexical.shared_terms(d, q, 2).orderBy("item_id", "rank").collect()]
    assert got == [(1, "a", 2.0, 1), (1, "b", 2.0, 2), (2, None, 1.0, 1)]
    nothing = d.limit(0)
    assert lexical.bm25(nothing, q).count() == 0 and lexical.bm25(d, q.limit(0)).count() == 0


def test_bounds_spare_postings(spark):
    rng = random.Random(5)
    # a common word in every document, and a rare one that settles the best
    docs = spark.createDataFrame([(i, "common " * rng.randint(1, 3) + f"rare{i % 40} filler{i % 7}") for i in range(3000)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"common rare{i}") for i in range(40)], "item_id long, text string")
    index = written(lexical.build_index(docs.coalesce(1)), "index")
    n, avg = lexical.statistics(index)
    weights = lexical.idf(index, lexical.asked_terms(asked, "item_id", "text"), n)
    seen = lexical.search(index, weights, 5, lexical.bm25_gain(avg), "item_id", "doc_id", 6, measure=True).agg(F.sum("postings"), F.sum("looked")).first()
    assert seen[0] == 40 * (3000 + 75) and seen[1] < 0.1 * seen[0]


def test_best_of_a_block_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(200):
        size, terms, k = int(rng.integers(1, 60)), int(rng.integers(1, 7)), int(rng.integers(1, 9))
        places = [np.sort(rng.choice(size, int(rng.integers(1, size + 1)), replace=False)) for _ in range(terms)]
        gains = [rng.integers(1, 5, len(p)) * float(rng.choice([0.01, 1, 7])) for p in places]
        whole = np.zeros(size)
        for p, g in zip(places, gains, strict=True):
            whole[p] += g
        docs, scores, _ = lexical._best(places, gains, np.array([g.max() for g in gains]), size, k)
        assert np.allclose(scores, whole[docs])
        least = np.sort(whole)[-k] if size >= k else 0
        assert set(np.flatnonzero((whole > 0) & (whole >= least))) <= set(docs.tolist())


def _peak_of_a_block(monkeypatch, tokens, texts=200):
    """Bytes of numpy arrays that a task takes for a block of so many tokens, at most."""
    frame = type("Frame", (), {"schema": {"key": type("Field", (), {"dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "bigint")})})}, "mapInArrow": lambda self, run, schema: run})
    monkeypatch.setattr(lexical.TaskContext, "get", lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)}))
    run = lexical.build_index(type("Docs", (), {"select": lambda self, *c: frame()})())
    lists = pa.array([[f"w{(i * 31 + j) % 997}" for j in range(tokens // texts)] for i in range(texts)], pa.list_(pa.string()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(texts)), lists], ["key", "t"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 998
    return most


def test_a_full_block_is_sorted_in_place(spark, monkeypatch):
    # 8 bytes a token for its cell, some more while cells are compared; 37 before
    assert _peak_of_a_block(monkeypatch, 400_000) < 28 * 400_000


def test_index_comes_in_batches_of_a_block(spark, monkeypatch):
    seen, real = [], lexical.written

    def looked(df, name):
        seen.append((name, spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")))
        return real(df, name)

    monkeypatch.setattr(lexical, "written", looked)
    d, q = spark.createDataFrame([(1, "alpha")], "doc_id long, text string"), spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert lexical.bm25(d, q).count() == lexical.shared_terms(d, q).count() == 1
    assert [n for name, n in seen if name == "index"] == [str(min(int(before), lexical.BLOCK_DOCUMENTS))] * 2
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before

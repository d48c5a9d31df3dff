"""Phrases: postings of a common term do not meet in one task, whichever way the terms get there."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import retrieval


@pytest.mark.parametrize("sent", [100_000, 0])
def test_common_terms_stay_with_their_documents(spark, monkeypatch, sent):
    monkeypatch.setattr(retrieval, "SENT_TERMS", sent, raising=False)
    docs = spark.createDataFrame([(i, "the " * 50 + ("the mit license" if i % 10 == 0 else "mit the license")) for i in range(100)] + [(100, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, 0, "the"), (1, 1, "mit"), (1, 2, "license"), (2, 0, "nowhere")], "qid int, i int, term string")
    post = retrieval.postings(docs, "doc_id", "text")
    got = retrieval.phrase(post, asked, "doc_id", "qid")
    assert sorted(tuple(r) for r in got.collect()) == [(1, i) for i in range(0, 100, 10)]
    assert sorted(tuple(r) for r in retrieval.any_term(post, asked, "doc_id", "qid").collect()) == [(1, i) for i in range(100)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == (sent > 0)

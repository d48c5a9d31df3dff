"""Counts of words against a plain count, handed over as Arrow columns."""

import collections

from tessera.llm import language_model


def test_counts_are_exact_and_columnar(spark):
    texts = [None, "", " \t", "A a B", "é É a", *(f"w{i % 7} w{i}" for i in range(300))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    counts = language_model.count_words(df)
    want = collections.Counter(w for t in texts for w in [*language_model.words_of(t), b""])
    assert {bytes(r.word): (r.hash, r.c) for r in counts.collect()} == {w: (language_model.word_hash(w), c) for w, c in want.items()}
    assert language_model.count_words(df.limit(0)).count() == 0
    # a row of Python objects for each word cost a third of the stage
    plan = counts._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan

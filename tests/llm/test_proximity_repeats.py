"""Proximity matches in texts that repeat words, against brute force."""

import random

from tessera.llm import decontaminate


def brute(words, phrase, slop):
    states = {(i, i) for i, w in enumerate(words) if w == phrase[0]}
    for p in phrase[1:]:
        states = {(s, k) for s, e in states for k in range(e + 1, min(e + slop + 2, len(words))) if words[k] == p}
    return states


def test_proximity_with_repeated_words(spark):
    rng = random.Random(2)
    texts = ["alpha beta x beta y gamma"] + [" ".join(rng.choice(["alpha", "beta", "gamma", "x", "y"]) for _ in range(14)) for _ in range(30)]
    phrases = [(1, ["alpha", "beta", "gamma"]), (2, ["beta", "alpha", "beta"]), (3, ["gamma"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.proximity_matches(docs, spark.createDataFrame(phrases, "phrase_id int, words array<string>"), 2).collect()
    want = sorted((i, p, s, e) for i, t in enumerate(texts) for p, ws in phrases for s, e in brute(t.split(), ws, 2))
    assert (0, 1, 0, 5) in want
    assert sorted(tuple(r) for r in got) == want

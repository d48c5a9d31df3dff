"""Substring deduplication removes only what stands together in one earlier text."""

import random

from tessera.llm import chunk_dedup


def test_short_chunks_seen_apart_are_no_passage(spark):
    rng = random.Random(3)
    words = [[rng.choice(["ban", "cet", "dix", "fol", "gum", "hara"]) for _ in range(150)] for _ in range(300)]
    windows = [tuple(w[k : k + 16]) for w in words for k in range(135)]
    assert len(set(windows)) == len(windows)
    copy = words[0][20:120]
    texts = [*(" ".join(w) for w in words), " ".join([*words[1][:5], *copy, *words[2][:5]])]
    got = {r.doc_id: r for r in chunk_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [i for i in range(300) if got[i].removed_words] == []
    assert 60 <= got[300].removed_words <= 100


def test_runs_do_not_depend_on_place_or_white_space():
    rng = random.Random(4)
    text = " ".join(rng.choice(["ban", "cet", "dix", "fol", "gum", "hara"]) for _ in range(400)).encode()
    a = chunk_dedup.runs(text, chunk_dedup.cuts(text), 16)
    moved = b"other words here " + text
    b = chunk_dedup.runs(moved, chunk_dedup.cuts(moved), 16)
    assert len(set(a[2].tolist()) - set(b[2].tolist())) <= 6
    at = chunk_dedup.cuts(text)
    for lo, hi in zip(a[0].tolist(), a[1].tolist(), strict=True):
        assert len(text[at[lo] : at[hi]].split()) >= 16

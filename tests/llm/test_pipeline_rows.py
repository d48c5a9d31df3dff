"""Rows of the pipeline under null and repeated keys; string keys and clashing columns of its operators."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests_prose import prose  # noqa: E402

from tessera.llm import chunk_dedup, packing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA)


def test_contaminated_rows_go_by_their_own_text(spark, tmp_path):
    rng = random.Random(21)
    item = prose(rng, 30)
    bad, good, other = f"{prose(rng, 20)} {item}", prose(rng, 60), prose(rng, 50)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, [(None, bad), (1, bad), (1, good), (None, other), (2, None), (2, ""), (None, None)])
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(1, good), (None, other), (2, None), (2, ""), (None, None)], key=str)


def test_one_of_each_group_stays_whatever_its_key(spark):
    rng = random.Random(22)
    a, b = prose(rng, 70), prose(rng, 70)
    near = a.split()
    near[30] = "EDIT"
    docs = frame(spark, [(1, a), (None, a), (1, a), (None, " ".join(near)), (7, b), (1, b), (None, None), (1, ""), (1, None)])
    left = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()]
    assert len(left) == 5
    assert sorted(t for _, t in left if t) in (sorted([a, b]), sorted([" ".join(near), b])) and sum(not t for _, t in left) == 3


def test_repeats_go_whatever_the_key(spark):
    rng = random.Random(23)
    passage = prose(rng, 70)
    docs = frame(spark, [(None, f"{prose(rng, 50)}\n{passage}"), (None, f"{prose(rng, 55)}\n{passage}\n{prose(rng, 50)}"), (3, prose(rng, 60)), (3, f"{prose(rng, 40)}\n{passage}")])
    left = corpus_pipeline.cut_repeats(spark, docs, "").collect()
    assert len(left) == 4 and sum(passage in r.text for r in left) == 1 and all(r.n_chars == len(r.text) for r in left)


def test_string_keys_and_clashing_columns(spark):
    rng = random.Random(24)
    passage = prose(rng, 70)
    rows = [("a", f"{prose(rng, 30)}\n{passage}", 1, "x", 5), ("b", f"{prose(rng, 30)}\n{passage}", 2, "y", 6), (None, passage, 3, "z", 7)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, later int, own string, id int")
    got = {r.doc_id: r for r in chunk_dedup.dedup(docs).collect()}
    assert passage in got["a"].text and passage not in got["b"].text and got[None].text == passage
    assert [(got[k].later, got[k].own, got[k].id) for k in ("a", "b")] == [(1, "x", 5), (2, "y", 6)]
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {r.doc_id for r in packed} == {"a", "b", None} and all(r.start + r.length <= r.doc_tokens for r in packed)

"""The five stages on a small fixture, against a step-by-step brute force."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests_prose import prose  # noqa: E402


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    passage, item = prose(rng, 70), prose(rng, 30)
    near = prose(rng, 120).split()
    edited = [*near[:60], "EDIT", *near[61:]]
    texts = {
        0: prose(rng, 100), 1: prose(rng, 80), 2: " ".join(near), 3: " ".join(edited), 4: f"{prose(rng, 60)}\n{passage}", 5: f"{prose(rng, 60)}\n{passage}\n{prose(rng, 55)}",
        6: f"{prose(rng, 60)} {item}", 7: prose(rng, 20), 8: " ".join(w + "###" for w in prose(rng, 90).split()), 9: None, 10: "", 11: f"{prose(rng, 900)} {item}",
    }
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, out = {}, docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / f"out{n}"))
        out = spark.read.parquet(str(tmp_path / f"out{n}"))
        kept[name] = sorted({r.doc_id for r in out.select("doc_id").collect()})
        if n < 4:
            assert out.columns == docs.columns
    assert kept["quality rules"] == [0, 1, 2, 3, 4, 5, 6, 11]
    assert kept["n-gram Jaccard join"] == [0, 1, 2, 4, 5, 6, 11]
    assert kept["substring dedup"] == [0, 1, 2, 4, 5, 6, 11]
    left = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert all(left[i].text == texts[i] for i in (0, 1, 2, 4, 6)) and len(left[5].text.split()) < 140 and left[5].n_chars == len(left[5].text)
    assert kept["benchmark decontamination"] == kept["packing"] == [0, 1, 2, 4, 5, 11]
    whole = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()))
    assert sum(x[2] for x in whole) == sum(r.length for r in out.collect())


def test_query_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [n for n in names if n.startswith("op") and n[2].isdigit()] and "pipeline" in names
    assert sorted({int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()}) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "packing"]
    assert set(entry.oracle_sql()) <= set(names)

"""Hash vectors of whole tables: the same as one by one, in memory that the number of different words does not move."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from tessera.operators import records


def test_vectors_are_those_of_single_texts(spark, monkeypatch):
    monkeypatch.setattr(records, "EMBEDDED_WORDS", 7)
    monkeypatch.setattr(records, "EMBEDDED_TEXTS", 3)
    rng = random.Random(3)
    texts = [None, "", "...", "Sun sun SUN!", "Ké x", *(" ".join(f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 60))) for _ in range(40))]
    for dimension in (64, 8, 3):
        got = records.hash_embeddings(pa.array(texts, pa.string()), dimension, records._Places(dimension)).to_pylist()
        assert got == [records.hash_embedding(t, dimension) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    rows = df.select("k", records.embedded(df["t"]).alias("v")).collect()
    assert {r.k: r.v for r in rows} == {k: pytest.approx(records.hash_embedding(t), abs=0) for k, t in enumerate(texts)}
    assert records.hash_embeddings(pa.array([], pa.string()), 4, records._Places(4)).to_pylist() == []


def test_memory_does_not_grow_with_different_words():
    def peak(n):
        texts = pa.array([" ".join(f"word{i * 50 + j}" for j in range(50)) for i in range(n)])
        tracemalloc.start()
        vector = records.hash_embeddings(texts, 64, records._Places(64))
        most = tracemalloc.get_traced_memory()[1] - vector.nbytes
        tracemalloc.stop()
        return most

    # 100,000 and 400,000 different words
    small, large = peak(2_000), peak(8_000)
    assert large < 1.2 * small + 8_000 * 64 * 8

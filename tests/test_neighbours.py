"""Exact nearest neighbours over cells: bounds spare pairs where vectors form groups, and lose nothing where they do not."""

import numpy as np
import pytest

from tessera.operators import neighbours


def brute(rows, asked, k, most=None):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    out = []
    for q, v in asked:
        u = np.array(v) / np.linalg.norm(v)
        best = sorted((round(1 - float(u @ x), 6) + 0.0, -i) for i, x in unit.items())
        out += [(q, -i, d, n + 1) for n, (d, i) in enumerate([b for b in best if most is None or b[0] <= most][:k])]
    return sorted(out)


def frames(spark, rows, asked):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(asked, "query_id long, embedding array<double>")


def groups(rng, n, dimension, number):
    centres = rng.standard_normal((number, dimension)) * 3
    return [(i, [float(x) for x in centres[i % number] + 0.15 * rng.standard_normal(dimension)]) for i in range(n)]


@pytest.mark.parametrize(("queries", "cell_rows"), [(2_000, 50_000), (3, 7)])
def test_grouped_vectors_are_mostly_spared(spark, monkeypatch, queries, cell_rows):
    monkeypatch.setattr(neighbours, "HELD_QUERIES", queries)
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(7)
    rows = groups(rng, 900, 16, 30)
    rows += [(900 + i, rows[5][1]) for i in range(12)]  # ties
    asked = [(i, v) for i, v in rows if i % 100 == 0]
    v, q = frames(spark, rows, asked)
    got = sorted((r.query_id, r.vec_id, r.distance, r["rank"]) for r in neighbours.knn(v, q, 8).collect())
    assert got == brute(rows, asked, 8)
    r = neighbours.knn(v, q, 8, measure=True).first()
    assert r.pairs == len(rows) * len(asked) and r.looked < 0.3 * r.pairs
    got = sorted((r.query_id, r.vec_id, r.distance, r["rank"]) for r in neighbours.knn(v, q, 8, max_distance=0.01).collect())
    assert got == brute(rows, asked, 8, 0.01)


def test_scattered_vectors_are_exact_too(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.standard_normal(24)]) for i in range(400)]
    asked = rows[:9]
    v, q = frames(spark, rows, asked)
    for pivots in (1, 40):
        cells = neighbours.build_cells(v, 24, "vec_id", "embedding", pivots)
        assert sorted((r.query_id, r.vec_id, r.distance, r["rank"]) for r in neighbours.knn(v, q, 5, cells=cells).collect()) == brute(rows, asked, 5)


def test_odd_vectors_and_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [-2.0, 0.0]), (None, [0.0, 3.0])]
    v, q = frames(spark, rows, [(10, [2.0, 0.0]), (11, None), (12, [0.0, 0.0])])
    assert sorted(((r.query_id, r.vec_id, r.distance) for r in neighbours.knn(v, q, 9).collect()), key=str) == sorted([(10, 1, 0.0), (10, None, 1.0), (10, 7, 2.0)], key=str)
    assert neighbours.knn(v.limit(0), q, 3).count() == 0 and neighbours.knn(v, q.limit(0), 3).count() == 0

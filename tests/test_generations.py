"""Vector storage by generation: switches, pinned readers, rollback, drops, checks of dimensions."""

from datetime import datetime, timedelta

import pytest

from tessera.operators.generations import Generations, Identity

DAY = timedelta(days=1)
T0 = datetime(2024, 5, 1)
A, B = Identity("local", "mini", "r1", 3), Identity("local", "mini", "r2", 2)


@pytest.fixture
def store(spark, tmp_path):
    return Generations(spark, f"file://{tmp_path}/generations")


def frame(spark, rows):
    return spark.createDataFrame(rows, "key long, source_hash string, embedding array<double>")


def read(df):
    return sorted((r.key, r.source_hash, r.embedding) for r in df.collect())


def test_one_is_active_and_identities_do_not_mix(store):
    a = store.activate(A, T0, "sum-a")
    assert store.activate(A, T0 + DAY).id == a.id and store.all()[0].activated == T0.isoformat()
    b = store.activate(B, T0 + DAY)
    assert [(g.id, g.status) for g in store.all()] == [(a.id, "retired"), (b.id, "active")] and store.get(a.id).retired == (T0 + DAY).isoformat()
    for other in ({"provider": "x"}, {"model": "x"}, {"revision": "x"}, {"dimension": 9}, {"pooling": "cls"}, {"normalization": "none"}):
        assert store.create(Identity(**{**B.__dict__, **other})).id not in (a.id, b.id)
    assert [g.id for g in store.all() if g.status == "active"] == [b.id]
    with pytest.raises(ValueError, match="dimension"):
        store.create(Identity("p", "m", "r", 0))


def test_readers_during_a_switch(spark, store):
    a = store.activate(A, T0)
    store.store(a.id, frame(spark, [(1, "h1", [1.0, 0.0, 0.0]), (2, "h2", [0.0, 1.0, 0.0])]))
    pinned = store.state()
    b = store.create(B)
    store.store(b.id, frame(spark, [(1, "h1", [0.5, 0.5])]))
    # it is filled, but nobody reads it before the switch
    assert [r[2] for r in read(store.vectors())] == [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]
    store.activate(B, T0 + DAY)
    assert read(store.vectors()) == [(1, "h1", [0.5, 0.5])]
    assert [r[0] for r in read(store.vectors(state=pinned))] == [1, 2] and store.active(pinned).id == a.id
    assert {r.key for r in store.missing(frame(spark, [(1, "h1", None), (1, "new", None), (2, "h2", None)]).select("key", "source_hash")).collect()} == {1, 2}
    # a new text replaces the vector; the pinned reader sees the old one
    before = store.state()
    store.store(b.id, frame(spark, [(1, "new", [0.0, 1.0]), (3, "h3", [1.0, 0.0])]))
    assert read(store.vectors()) == [(1, "new", [0.0, 1.0]), (3, "h3", [1.0, 0.0])] and read(store.vectors(state=before)) == [(1, "h1", [0.5, 0.5])]


def test_roll_back_and_drop(spark, store):
    a = store.activate(A, T0)
    store.store(a.id, frame(spark, [(1, "h1", [1.0, 0.0, 0.0])]))
    b = store.activate(B, T0 + DAY)
    with pytest.raises(ValueError, match="cannot be dropped"):
        store.drop(a.id, T0 + 2 * DAY, 7 * DAY)
    assert store.roll_back(T0 + 2 * DAY, 7 * DAY).id == a.id and read(store.vectors()) == [(1, "h1", [1.0, 0.0, 0.0])]
    with pytest.raises(LookupError):
        store.roll_back(T0 + 20 * DAY, 7 * DAY)
    with pytest.raises(ValueError, match="active"):
        store.drop(a.id, T0 + 90 * DAY, 7 * DAY)
    store.drop(b.id, T0 + 20 * DAY, 7 * DAY)
    assert [g.id for g in store.all()] == [a.id]
    with pytest.raises(KeyError):
        store.vectors(b.id)
    # an id is not given twice
    assert store.create(B).id > b.id and store.get(store.create(B).id).batches == 0


def test_vectors_that_do_not_fit(spark, store):
    a = store.activate(A, T0)
    for bad in ((1, "h", [1.0, 2.0]), (1, "h", None), (1, "h", [1.0, 2.0, float("nan")]), (1, "h", [1.0, 2.0, float("inf")]), (1, "h", [1.0, None, 2.0]), (None, "h", [1.0, 2.0, 3.0])):
        with pytest.raises(ValueError, match="1 vectors do not fit"):
            store.store(a.id, frame(spark, [(7, "h", [1.0, 2.0, 3.0]), bad]))
    assert store.vectors() is None
    store.store(a.id, frame(spark, []))
    assert store.vectors().count() == 0
    store.store(a.id, frame(spark, [(1, "old", [1.0, 2.0, 3.0]), (2, "h2", [1.0, 2.0, 3.0])]), frame(spark, [(1, "new", None), (2, "h2", None)]))
    assert [r[0] for r in read(store.vectors())] == [2]
    store.failed(a.id, "x" * 3_000)
    assert len(store.get(a.id).error) == 2_000 and store.activate(A, T0).error


def test_two_writers(store):
    store.activate(A, T0)
    n = store.states.latest()
    store.states.latest = lambda: n - 1 if n > 1 else n
    with pytest.raises((FileExistsError, KeyError)):
        store.failed(1, "late")

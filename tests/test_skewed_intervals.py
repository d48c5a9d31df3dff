"""Interval existence where one resource holds nearly all events, against brute force."""

import datetime
import random

import pytest

from tessera.operators import analytics

START = datetime.datetime(2024, 3, 30, 22)


@pytest.mark.parametrize(("hours", "slots"), [(24, 60), (2, 8), (1, 1)])
def test_flags_of_a_hot_resource(spark, hours, slots):
    rng = random.Random(hours)
    moment = lambda: START + datetime.timedelta(seconds=rng.randrange(96 * 3600), microseconds=rng.choice([0, 0, 1, 999_999]))
    resource = lambda: 7 if rng.random() < 0.99 else rng.choice([1, 2, 3, None])
    events = [(resource(), moment(), rng.choice(["verified", "settled", "failed"])) for _ in range(700)]
    shown = [(i, resource(), moment()) for i in range(600)] + [(1000, 7, None), (1001, None, START), (1002, 99, START)]
    # both ends of the interval, and just beyond
    for i, gap in enumerate([0, hours * 3600, hours * 3600 + 1e-6, -1e-6]):
        shown.append((2000 + i, 50 + i, START))
        events.append((50 + i, START + datetime.timedelta(seconds=gap), "settled"))
    a = spark.createDataFrame(shown, "id long, resource_id long, created_at timestamp_ntz")
    b = spark.createDataFrame(events, "resource_id long, occurred_at timestamp_ntz, stage string")
    got = {r.id: (r.verified, r.settled) for r in analytics.conversion_flags(a, b, hours, slots).collect()}
    window = datetime.timedelta(hours=hours)

    def hit(r, t, stage):
        return t is not None and r is not None and any(e == r and s == stage and t <= at <= t + window for e, at, s in events)

    assert got == {i: (hit(r, t, "verified"), hit(r, t, "settled")) for i, r, t in shown}
    assert [got[2000 + i][1] for i in range(4)] == [True, True, False, False]
    assert analytics.conversion_flags(a.limit(0), b, hours, slots).count() == 0


def test_slots_must_divide(spark):
    empty = spark.createDataFrame([], "id long, resource_id long, created_at timestamp_ntz")
    with pytest.raises(ValueError, match="divide"):
        analytics.conversion_flags(empty, spark.createDataFrame([], "resource_id long, occurred_at timestamp_ntz, stage string"), 24, 7_000)

"""Reservations: an event's cost does not depend on how many payments are open, and changes by payment add up to the fold's sums."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.streaming import folds

EVENTS = "agent string, id long, payment string, kind string, amount long"


class Open(dict):
    """Open payments that are never summed up again."""

    def values(self):
        raise AssertionError("all open payments were looked at")


def test_an_event_looks_at_its_own_payment_only():
    step = folds.reservations()
    state = {"held": Open(a=5), "done": {}, "settled": 0, "reserved": 5}
    for kind, payment, sums in (("reserve", "b", (12, 0)), ("reserve", "b", (12, 0)), ("settle", "a", (7, 7)), ("unknown", "b", (7, 7)), ("release", "b", (0, 7)), ("reserve", "a", (0, 7))):
        state, row = step(state, {"id": 1, "payment": payment, "kind": kind, "amount": 7})
        assert (row["reserved"], row["settled"]) == sums
    # a kept state of before has no sum
    assert step({"held": {"a": 5}, "done": {}, "settled": 1}, {"id": 2, "payment": "b", "kind": "reserve", "amount": 2})[1] == {"id": 2, "reserved": 7, "settled": 1}


def test_changes_add_up_to_the_fold(spark):
    rng = random.Random(31)
    kinds = ["reserve", "reserve", "settle", "release", "unknown", None]
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(["p", "q", "r", "s", None]), rng.choice(kinds), rng.randrange(1, 50)) for i in range(400)]
    events = spark.createDataFrame(rows, EVENTS).repartition(3)
    so_far = Window.partitionBy("agent").orderBy("id")
    changes = folds.reservation_changes(events, "agent", ["id"])
    got = {r.id: (r.reserved, r.settled) for r in changes.select("id", F.sum("reserved").over(so_far).alias("reserved"), F.sum("settled").over(so_far).alias("settled")).collect()}
    want = folds.fold_batch(events, "agent", ["id"], folds.reservations(), "id long, reserved long, settled long")
    assert got == {r.id: (r.reserved, r.settled) for r in want.collect()} and len(got) == 400 and max(s for _, s in got.values()) > 0

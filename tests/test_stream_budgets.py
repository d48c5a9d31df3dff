"""Keyed state of streams: results equal the batch folds, and the state store forgets what is finished."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import budgets, folds

START = datetime(2024, 1, 1)
EVENTS = "agent string, id long, payment string, kind string, amount long, ts timestamp"


@pytest.fixture
def store(spark):
    before = spark.conf.get(budgets.STATE_STORE[0])
    spark.conf.set(*budgets.STATE_STORE)
    yield
    spark.conf.set(budgets.STATE_STORE[0], before)


class Feed:
    """A folder that a stream reads, a micro-batch a file."""

    def __init__(self, spark, path, schema, build):
        self.spark, self.path, self.schema, self.build, self.given, self.n = spark, path, schema, build, [], 0

    def add(self, rows):
        self.given += rows
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").json(f"{self.path}/in")

    def run(self):
        source = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(f"{self.path}/in")
        out = self.build(source).writeStream.format("parquet").option("path", f"{self.path}/out").option("checkpointLocation", f"{self.path}/checkpoint")
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(f"{self.path}/out")

    def state(self, name):
        return self.spark.read.format("statestore").option("stateVarName", name).load(f"{self.path}/checkpoint").count()


def test_reservations_equal_the_batch_fold_and_forget(spark, store, tmp_path):
    rng = random.Random(12)
    feed = Feed(spark, tmp_path, EVENTS, lambda s: budgets.reservations_stream(s, "agent", timedelta(hours=2)))
    sizes = []
    for batch in range(4):
        rows = []
        for i in range(60):
            n = 60 * batch + i
            # payments live within one hour, so that none is forgotten while its repeats come
            payment, kind = f"p{n // 20}-{rng.randrange(6)}", rng.choice(["reserve", "reserve", "settle", "release", "unknown"])
            rows.append((rng.choice(["a", "b", None]), n, payment, kind, rng.randrange(1, 50), START + timedelta(hours=6 * batch, minutes=i % 60)))
        feed.add(rows)
        got = {r.id: (r.reserved, r.settled) for r in feed.run().collect()}
        want = folds.fold_batch(spark.createDataFrame(feed.given, EVENTS), "agent", ["id"], folds.reservations(), "id long, reserved long, settled long")
        assert got == {r.id: (r.reserved, r.settled) for r in want.collect()}
        sizes.append(feed.state("done"))
    finished = sum(r.settled for r in feed.run().collect()) > 0
    # the state holds the finished payments of the last batch or two, not of all four
    assert finished and max(sizes) <= 2 * sizes[0] + 18 and sizes[-1] <= sizes[0] + 12


def test_a_repeat_after_its_time_is_a_new_payment(spark, store, tmp_path):
    feed = Feed(spark, tmp_path, EVENTS, lambda s: budgets.reservations_stream(s, "agent", timedelta(hours=1)))
    at = lambda h: START + timedelta(hours=h)
    feed.add([("a", 1, "p", "reserve", 5, at(0)), ("a", 2, "p", "settle", 5, at(0)), ("a", 3, "p", "reserve", 5, at(0)), ("a", 4, "q", "reserve", 7, at(0))])
    feed.add([("b", 5, "x", "reserve", 1, at(3))])
    feed.add([("b", 6, "x", "unknown", 1, at(6))])
    feed.add([("a", 7, "p", "reserve", 5, at(7)), ("a", 8, "q", "release", 7, at(7))])
    got = {r.id: (r.reserved, r.settled) for r in feed.run().collect()}
    assert got == {1: (5, 0), 2: (0, 5), 3: (0, 5), 4: (7, 5), 5: (1, 0), 6: (1, 0), 7: (12, 5), 8: (5, 5)}
    assert feed.state("held") == 2


def test_daily_budgets_equal_the_batch_fold_and_forget(spark, store, tmp_path):
    rng = random.Random(13)
    schema = "scope string, id long, amount long, ts timestamp"
    feed = Feed(spark, tmp_path, schema, lambda s: budgets.daily_budget_stream(s, "scope", 100, timedelta(hours=1)))
    sizes = []
    for day in range(4):
        for half in range(2):
            feed.add([(rng.choice("xyz"), 100 * day + 50 * half + i, rng.randrange(1, 40), START + timedelta(days=day, hours=12 * half, minutes=i)) for i in range(30)])
        got = {r.id: (r.admitted, r.spent) for r in feed.run().collect()}
        rows = spark.createDataFrame(feed.given, schema).withColumn("key", F.concat_ws(" ", F.to_date("ts"), "scope"))
        want = folds.fold_batch(rows.select("key", "id", "amount"), "key", ["id"], folds.budget(100), "id long, admitted boolean, spent long")
        assert got == {r.id: (r.admitted, r.spent) for r in want.collect()} and not all(ok for ok, _ in got.values())
        sizes.append(feed.state("spent"))
    assert sizes[-1] <= 6

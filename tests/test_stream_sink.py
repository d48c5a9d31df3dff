"""A stream of upserts against the batch rollup: replays, failures, restarts, pinned readers, merged versions."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.sources.commits import Commits
from tessera.streaming import folds
from tessera.streaming.sink import AppendSink, UpsertSink

SCHEMA = "id long, stage string, seq long, dim string, amount long"


def events(rng, n, start):
    return [(rng.randrange(12) if rng.random() > 0.05 else None, rng.choice("ab"), start + i, rng.choice(["x", "y", None, "gone"] if start < 60 else ["x", "y", None]), rng.randrange(100)) for i in range(n)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def batch_rollup(spark, given):
    return rows(folds.retractions(spark.createDataFrame(given, SCHEMA), ["id", "stage"], "seq", ["dim"], "amount"))


def sink_of(spark, path):
    return UpsertSink(spark, f"file://{path}/sink", ["id", "stage"], "seq", ["dim"], "amount", buckets=3)


class Broken(Exception):
    pass


def run(spark, sink, path, write=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{path}/in")
    q = stream.writeStream.foreachBatch(write or sink.write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_equals_batch_over_failure_restart_and_replay(spark, tmp_path):
    rng = random.Random(3)
    given, sink = [], sink_of(spark, tmp_path)
    assert sink.rollup() is None and sink.facts() is None and sink.watermark() == 0

    def arrive(n):
        new = events(rng, 40, len(given))
        given.extend(new)
        spark.createDataFrame(new, SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")

    arrive(1)
    run(spark, sink, tmp_path)
    first = batch_rollup(spark, given)
    assert rows(sink.rollup()) == first and sink.watermark() == 1
    # the second batch fails after its rows are written and before its commit
    arrive(2)
    whole = sink.commits.commit
    sink.commits.commit = lambda *a: (_ for _ in ()).throw(Broken())
    with pytest.raises(Exception, match="Broken"):
        run(spark, sink, tmp_path)
    sink.commits.commit = whole
    assert sink.watermark() == 1 and rows(sink.rollup()) == first
    # a new process takes it up again
    sink = sink_of(spark, tmp_path)
    run(spark, sink, tmp_path)
    assert sink.watermark() == 2 and rows(sink.rollup()) == batch_rollup(spark, given)
    arrive(3)
    run(spark, sink, tmp_path)
    now = rows(sink.rollup())
    assert now == batch_rollup(spark, given) and any(r[0] == "gone" and r[1:] == (0, 0) for r in now) == (("gone", 0, 0) in now)
    # a batch that comes again changes nothing
    sink.write(spark.createDataFrame(given[:40], SCHEMA), 0)
    sink.write(spark.createDataFrame(given[80:], SCHEMA), 2)
    assert sink.watermark() == 3 and rows(sink.rollup()) == now
    # readers that pinned a version keep it
    assert rows(sink.rollup(1)) == first and rows(sink.rollup(2)) == batch_rollup(spark, given[:80])
    last = {(r.id, r.stage): (r.seq, r.dim, r.amount) for r in sink.facts().collect()}
    assert last == {k: max(((s, d, a) for i, g, s, d, a in given if (i, g) == k), key=lambda x: x[0]) for k in {(i, g) for i, g, *_ in given}}
    with pytest.raises(ValueError, match="version 4"):
        sink.rollup(4)
    # merged versions give the same, and earlier ones are gone
    sink.merge(2)
    assert rows(sink.rollup()) == now and rows(sink.rollup(2)) == batch_rollup(spark, given[:80])
    with pytest.raises(ValueError, match="version 1"):
        sink.rollup(1)
    arrive(4)
    run(spark, sink, tmp_path)
    assert rows(sink.rollup()) == batch_rollup(spark, given)


def test_late_and_equal_writes(spark, tmp_path):
    sink = sink_of(spark, tmp_path)
    one = lambda *r: spark.createDataFrame([r], SCHEMA)
    sink.write(one(1, "a", 10, "x", 5), 0)
    sink.write(one(1, "a", 9, "y", 7), 1)  # out of date
    sink.write(one(1, "a", 10, "x", 5), 2)  # the same again, as a batch of its own
    assert rows(sink.rollup()) == [("x", 1, 5), ("y", 0, 0)]
    sink.write(one(1, "a", 11, "y", None), 3)
    assert rows(sink.rollup()) == [("x", 0, 0), ("y", 1, 0)]
    sink.write(spark.createDataFrame([], SCHEMA), 4)
    assert sink.watermark() == 5 and rows(sink.rollup()) == [("x", 0, 0), ("y", 1, 0)]
    assert rows(sink.facts()) == [(1, "a", 11, "y", None)]
    sink.merge()
    assert rows(sink.facts()) == [(1, "a", 11, "y", None)] and rows(sink.rollup()) == [("x", 0, 0), ("y", 1, 0)]


def test_untouched_buckets_are_not_read(spark, tmp_path):
    sink = sink_of(spark, tmp_path)
    many = spark.range(30).select("id", F.lit("a").alias("stage"), F.col("id").alias("seq"), F.lit("x").alias("dim"), F.col("id").alias("amount"))
    sink.write(many, 0)
    schema = spark.read.parquet(f"{sink.path}/facts/version=1").schema
    plan = sink._state(1, ["seq", "dim", "amount"], schema, [2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "(bucket#" in plan


def test_a_number_is_committed_once(spark, tmp_path):
    log = Commits(spark, f"file://{tmp_path}/log")
    assert log.latest() == 0
    log.commit(1, "é")
    assert log.read(1) == "é" and log.numbers() == [1]
    with pytest.raises(FileExistsError):
        log.commit(1, "other")
    assert log.read(1) == "é"


def test_a_log_has_each_event_once(spark, tmp_path):
    log = AppendSink(spark, f"file://{tmp_path}/log", ["id"], buckets=3)
    frame = lambda rows: spark.createDataFrame(rows, "id long, kind string, at long")
    assert log.events() is None
    empty = AppendSink(spark, f"file://{tmp_path}/empty", ["id"])
    empty.write(frame([]), 0)
    empty.write(frame([(1, "a", 1)]), 1)
    assert rows(empty.events()) == [(1, "a", 1)] and rows(empty.events(1)) == []
    log.write(frame([(1, "a", 5), (1, "a", 4), (2, "b", 6), (None, "c", 7)]), 0)
    first = [(1, "a", 4), (2, "b", 6), (None, "c", 7)]
    assert rows(log.events()) == sorted(first, key=str)
    log.write(frame([(2, "changed", 9), (3, "d", 8), (None, "c", 7)]), 1)
    log.write(frame([(1, "a", 5)]), 2)
    log.write(frame([(9, "late", 1)]), 1)
    assert rows(log.events()) == sorted([*first, (3, "d", 8)], key=str) and rows(log.events(1)) == sorted(first, key=str)
    # a batch that failed before its commit is written anew
    whole = log.commits.commit
    log.commits.commit = lambda *a: (_ for _ in ()).throw(Broken())
    with pytest.raises(Broken):
        log.write(frame([(4, "e", 1), (5, "f", 1)]), 3)
    log.commits.commit = whole
    assert log.events().count() == 4
    log.write(frame([(4, "e", 1)]), 3)
    assert log.events().count() == 5

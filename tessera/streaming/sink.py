"""Upserts of a stream with retractions of their rollup, in versions that readers can pin.

A micro-batch becomes one version: the rows that replaced others, by bucket of their key, and what the rollup changes by. A
version is read once its commit exists; a batch that comes again after a failure writes its version anew, and one that is
committed already changes nothing. Readers take the rollup and the rows as of any version that has not been merged away.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.commits import Commits
from tessera.sources.scratch import remove


class UpsertSink:
    """Facts by key, last write first, and their rollup (dimensions, transactions, amount).

    Of the writes of a key the one with the greatest (order, row) counts, so that the result depends neither on how writes
    are dealt to batches nor on repeated ones. Rollup rows of dimensions that no fact has any more stay, with zeros. order,
    dimensions and amount may be null; a null key is a key.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: str, dimensions: list[str], amount: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.order, self.dimensions, self.amount, self.buckets = key, order, dimensions, amount, buckets
        self.commits = Commits(spark, f"{self.path}/commits")
        self.merged = Commits(spark, f"{self.path}/merged")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: batch number n is version n + 1."""
        version = batch_id + 1
        if version <= self.commits.latest():
            return
        fields = [self.order, *[c for c in batch.columns if c not in (*self.key, self.order)]]
        new = batch.groupBy(*self.key).agg(F.max(F.struct(*fields)).alias("now")).withColumn("bucket", self._bucket())
        new = self._placed(new, f"facts/version={version}")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        old = self._state(version - 1, fields, new.schema, touched)
        same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ["bucket", *self.key]])
        both = new.alias("n").join(old.alias("o"), same, "left").select(F.col("n.now").alias("now"), F.col("o.now").alias("before"))
        # what is not greater than what is there falls away
        wins = F.col("before").isNull() | (F.col("now") > F.col("before"))
        of = lambda row, sign: F.struct(*[F.col(f"{row}.{c}").alias(c) for c in self.dimensions], F.lit(sign).cast("long").alias("transactions"), (sign * F.col(f"{row}.{self.amount}")).cast("long").alias("amount"))
        steps = both.filter(wins).select(F.explode(F.array_compact(F.array(of("now", 1), F.when(F.col("before").isNotNull(), of("before", -1))))).alias("d")).select("d.*")
        # dimensions of writes that were replaced within the batch or fell away have rows too
        seen = batch.select(*self.dimensions).distinct().withColumns({"transactions": F.lit(0).cast("long"), "amount": F.lit(0).cast("long")})
        self._placed(self._summed(steps.unionByName(seen)), f"rollup/version={version}")
        self.commits.commit(version, new.schema.json())

    def watermark(self) -> int:
        """The last version: every version up to it is committed and none of them can change."""
        return self.commits.latest()

    def rollup(self, version: int | None = None) -> DataFrame | None:
        """The rollup as of a version; null before the first."""
        v = self._pinned(version)
        return self._summed(self._read("rollup", v)) if v else None

    def facts(self, version: int | None = None) -> DataFrame | None:
        """The last write of each key as of a version, as rows of the stream; null before the first."""
        v = self._pinned(version)
        if not v:
            return None
        last = self._read("facts", v).groupBy("bucket", *self.key).agg(F.max("now").alias("now"))
        return last.select(*self.key, "now.*")

    def merge(self, version: int | None = None) -> None:
        """Puts all versions up to one together, so that reads and writes need not go through them one by one. Earlier versions can
        no longer be read; a merge that fails leaves nothing that is read."""
        v = self._pinned(version)
        if not v or v <= self.merged.latest():
            return
        last = self._read("facts", v).groupBy("bucket", *self.key).agg(F.max("now").alias("now"))
        self._placed(last, f"facts/merged={v}")
        self._placed(self._summed(self._read("rollup", v)), f"rollup/merged={v}")
        before = self.merged.latest()
        self.merged.commit(v)
        for name in ("facts", "rollup"):
            for n in range(before + 1, v + 1):
                remove(self.spark, f"{self.path}/{name}/version={n}")
            if before:
                remove(self.spark, f"{self.path}/{name}/merged={before}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _placed(self, df: DataFrame, name: str) -> DataFrame:
        """df written whole in place of what a failed attempt has left there, by bucket where it has one."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy("bucket") if "bucket" in df.columns else writer).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.dimensions).agg(F.sum("transactions").alias("transactions"), F.coalesce(F.sum("amount"), F.lit(0).cast("long")).alias("amount"))

    def _pinned(self, version: int | None) -> int:
        last = self.commits.latest()
        v = last if version is None else version
        if v > last or v < self.merged.latest():
            raise ValueError(f"version {v} is not between {self.merged.latest()} and {last}")
        return v

    def _paths(self, name: str, version: int) -> list[str]:
        base = self.merged.latest()
        return [*([f"{self.path}/{name}/merged={base}"] if base else []), *(f"{self.path}/{name}/version={n}" for n in range(base + 1, version + 1))]

    def _read(self, name: str, version: int) -> DataFrame:
        # a version of an empty batch has no facts and so no files, so their schema comes with the commits
        schema = StructType.fromJson(json.loads(self.commits.read(version))) if name == "facts" else None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reduce(DataFrame.unionByName, [reader.parquet(p) for p in self._paths(name, version)])

    def _state(self, version: int, fields: list[str], schema, buckets: list[int]) -> DataFrame:
        """The last write of each key of these buckets; other buckets are not read."""
        paths = self._paths("facts", version)
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(p) for p in paths]).filter(F.col("bucket").isin(buckets))
        return rows.groupBy("bucket", *self.key).agg(F.max("now").alias("now"))


class AppendSink:
    """A log of events that each stand in it once, whatever is sent again: observations, audit entries.

    Batches are versions as those of UpsertSink; of a batch only events whose key is not in the log yet are added, of
    repeated ones in a batch the smallest row. What is in the log never changes.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.commits = Commits(spark, f"{self.path}/commits")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: batch number n is version n + 1."""
        version = batch_id + 1
        last = self.commits.latest()
        if version <= last:
            return
        rest = [c for c in batch.columns if c not in self.key]
        once = batch.groupBy(*self.key).agg(F.min(F.struct(*rest)).alias("row")).withColumn("bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
        if last:
            touched = [r.bucket for r in once.select("bucket").distinct().collect()]
            old = self._all(last).filter(F.col("bucket").isin(touched)).select("bucket", *self.key)
            same = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in ["bucket", *self.key]])
            once = once.alias("n").join(old.alias("o"), same, "left_anti")
        once.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version}")
        self.commits.commit(version, once.schema.json())

    def events(self, version: int | None = None) -> DataFrame | None:
        """The log as of a version; null before the first."""
        v = self.commits.latest() if version is None else version
        return self._all(v).select(*self.key, "row.*") if v else None

    def _all(self, version: int) -> DataFrame:
        # a version without new events has no files, so the schema comes with the commits
        schema = StructType.fromJson(json.loads(self.commits.read(1)))
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/version={n}") for n in range(1, version + 1)])


def in_parts(write: Callable[[DataFrame, int], None], parts: int, by: list[str]) -> Callable[[DataFrame, int], None]:
    """A writer for foreachBatch that passes each batch on as `parts` smaller ones, dealt by a hash of columns."""

    def each(batch: DataFrame, batch_id: int) -> None:
        for n in range(parts):
            write(batch.filter(F.pmod(F.xxhash64(*by), F.lit(parts)) == n), batch_id * parts + n)

    return each

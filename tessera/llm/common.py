"""Shared plumbing of the corpus operators: tables, scratch tables in the shared folder, ASCII text helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract: blank and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in an Arrow batch; texts can be long, so batches stay small.
BATCH_ROWS = 512

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of an Arrow batch of whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextmanager
def single_threaded(spark: SparkSession) -> Iterator[None]:
    """Python functions made inside run with one BLAS thread a task: tasks fill the cores, and small products only lose by more."""
    env, name = spark.sparkContext.environment, "OPENBLAS_NUM_THREADS"
    before = env.get(name)
    env[name] = "1"
    try:
        yield
    finally:
        env.pop(name)
        if before is not None:
            env[name] = before


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; where none is set, a temporary one on a single machine, and an
    error on a cluster, whose machines would each write to a folder of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
        _made.append((spark, root))
    return root


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was written in the shared folder meanwhile; results that read it must have been written before."""
    scratch_root(spark)
    mark = len(_made)
    yield
    for owner, path in _made[mark:]:
        remove(owner, path)
    del _made[mark:]


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder when the process ends."""
    _made.append((spark, path))


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        if path.startswith(f"file://{tempfile.gettempdir()}/tessera-"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
            continue
        try:
            remove(spark, path)
        except Exception:  # the session may have ended before
            pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it again.

    A lost executor then costs the tasks in flight only. The driver's JVM is asked to collect its garbage, so that the
    shuffle files of what was written go as well.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tessera-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _made.append((spark, path.rsplit("/", 1)[0]))
    out = spark.read.schema(df.schema).parquet(path)
    del df
    spark.sparkContext._jvm.System.gc()
    return out


def broadcast_if_small(written: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast where its counted rows are at most `rows` (some 100 MB); larger ones
    are left to Spark's shuffled joins."""
    return F.broadcast(written) if written.count() <= rows else written


def ascii_lower(c: Column) -> Column:
    """A-Z only: lower() on pure ASCII, a character map where other letters occur (lower() would change them too)."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(n))

"""Sources and sinks: JSON lines with per-line errors, canonical JSON lines, pinned manifests, landed payloads, cursors."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, rules: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): rows that parse and meet every rule; errors (file, line_number, line, issues) for the others.

    rules: name to a boolean Column that is true where a row breaks it. A malformed line is an issue of its own and does not
    stop the rest. Line numbers are counted for files with errors only, by a second read of these: the text source splits
    large files, so a line's number is that of the lines before its split and its place in it, both in the order of the file.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    typed = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    parsed = lines.filter(F.length(F.trim("line")) > 0).withColumn("row", F.from_json("line", typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})).select("file", "block", "at", "line", "row.*")
    issues = [F.when(F.col(BAD).isNotNull(), F.lit("malformed"))]
    issues += [F.when(F.col(BAD).isNull() & F.col(f.name).isNull(), F.lit(f"missing {f.name}")) for f in schema.fields if not f.nullable]
    issues += [F.when(F.col(BAD).isNull() & F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in (rules or {}).items()]
    checked = parsed.withColumn("issues", F.array_compact(F.array(*issues)))
    bad = checked.filter(F.size("issues") > 0).select("file", "block", "at", "line", "issues")
    marked = lines.join(bad.select("file").distinct(), "file", "left_semi")
    blocks = marked.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = bad.join(blocks.withColumn("before", before).drop("n"), ["file", "block"])
    errors = numbered.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).cast("long").alias("line_number"), "line", "issues")
    return checked.filter(F.size("issues") == 0).select(*[f.name for f in schema.fields]), errors


def is_partial(errors: DataFrame) -> bool:
    """Whether a tolerant read has left lines out."""
    return not errors.isEmpty()


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line with keys in byte order; null fields are left out."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.text(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


#: Stores that tasks open as streams themselves; files of others are read by Spark as a whole, up to its 2 GB a value.
STREAMED = ("file", "hdfs", "s3", "gs")
#: Bytes of a file that a task holds.
PIECE = 8 << 20


def opened(name: str):
    """A file as a stream; name is as Spark lists it, without escapes."""
    if name.startswith("file:"):
        return open("/" + name.removeprefix("file:").lstrip("/"), "rb")
    store, inner = fs.FileSystem.from_uri(quote(name, safe=":/"))
    return store.open_input_stream(inner)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file below a path; Spark lists no empty ones.

    Spark lists the files and deals them to tasks; a task reads its files as streams, a piece after the other, so that files of
    any size need little memory. A file's bytes are in order, so a file is one task.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    scheme = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme()
    if scheme not in STREAMED:
        return listed.select("path", F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name in b.column(0).to_pylist():
                digest = hashlib.sha256()
                with opened(name) as stream:
                    while piece := stream.read(PIECE):
                        digest.update(piece)
                out.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["path", "sha256"])

    # the contents are not read by the listing; large files are dealt out, not packed together
    return listed.select("path").repartition("path").mapInArrow(run, "path string, sha256 string")


def drift(pinned: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state) of files that are missing, extra or changed against a pinned manifest; empty: nothing is stale."""
    p, a = pinned.select("path", F.col("sha256").alias("p")), actual.select("path", F.col("sha256").alias("a"))
    state = F.when(F.col("a").isNull(), "missing").when(F.col("p").isNull(), "extra").when(F.col("p") != F.col("a"), "changed")
    return p.join(a, "path", "full_outer").select("path", state.alias("state")).filter("state is not null")


#: Names under which landed payloads keep their list of records, in order of preference.
CONTAINERS = ("items", "resources", "services", "results", "data")


def payload_items(payloads: DataFrame, source: str = "source", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(items, failures): records of each landed JSON payload: those under the first container key that is an array, those of
    the payload itself where it is an array, and an object without a container is one record. A source that cannot be read is
    a failure and does not stop the others."""
    arrays = [F.from_json(F.get_json_object(body, f"$.{k}"), "array<string>") for k in CONTAINERS]
    starts = F.substring(F.ltrim(F.col(body)), 1, 1)
    # an object that parses has keys, if none at all an empty array of them
    alone = F.when((starts == "{") & F.json_object_keys(body).isNotNull(), F.array(F.col(body)))
    listed = F.coalesce(*arrays, F.when(starts == "[", F.from_json(body, "array<string>")), alone)
    found = payloads.select(source, listed.alias("items"))
    return found.select(source, F.explode("items").alias("item")), found.filter("items is null").select(source)


def sign_cursor(state: dict, secret: bytes) -> str:
    """A page cursor: canonical JSON and its HMAC, in URL-safe text. state holds version, offset, fingerprint and expires."""
    body = json.dumps(state, sort_keys=True, separators=(",", ":")).encode()
    text = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    return f"{text(body)}.{text(hmac.new(secret, body, hashlib.sha256).digest())}"


def open_cursor(cursor: str, secret: bytes, now: float, fingerprint: str) -> dict:
    """The state of a cursor that is whole, not expired and made for the same filters; ValueError otherwise."""
    raw = lambda t: base64.urlsafe_b64decode(t + "=" * (-len(t) % 4))
    try:
        body, mark = (raw(t) for t in cursor.split("."))
        state = json.loads(body)
    except ValueError as e:
        raise ValueError("malformed cursor") from e
    if not hmac.compare_digest(mark, hmac.new(secret, body, hashlib.sha256).digest()):
        raise ValueError("forged cursor")
    if state["expires"] <= now:
        raise ValueError("expired cursor")
    if state["fingerprint"] != fingerprint:
        raise ValueError("cursor of other filters")
    return state


def fingerprint(filters: dict) -> str:
    return hashlib.sha256(json.dumps(filters, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

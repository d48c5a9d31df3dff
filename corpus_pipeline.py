"""A corpus pipeline of five stages over `documents`: rules, near copies, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before has kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chunk_dedup, decontaminate, ngram_join, packing, quality_rules
from tessera.llm.common import broadcast_if_small, keep_until_exit, materialize, remove, scratch_root, swept, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.judge(docs).filter("kept").select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a number of each row, written: keys may be null or repeated, and what a stage decides holds for a row."""
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "numbered")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 over 5-word shingles, the first row; also where keys are null
    or repeated."""
    rows = numbered(docs)
    groups = ngram_join.jaccard_components(rows, k=5, percent=80, key="row")
    others = materialize(groups.filter("component_id <> row").select("row"), "others")
    return rows.join(broadcast_if_small(others), "row", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier row has; those of which nothing is left go."""
    left = chunk_dedup.dedup(numbered(docs), key="row").filter((F.col("removed_words") == 0) | (F.col("removed_words") < F.col("n_words")))
    return left.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at most a twentieth lies in 13-word windows of the benchmark. A row is judged by its text alone, so that
    the digest of the text says which rows go, whatever their keys."""
    named = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    found = decontaminate.contamination(named, table(spark, sf_dir, "benchmark"), key="digest")
    bad = materialize(found.filter("contaminated").select("digest").distinct(), "contaminated")
    return named.join(broadcast_if_small(bad), "digest", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]
#: Not expressible: tokens and places of pieces come from a tokenizer and a packer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each one's result is written to the shared folder and read again as the next one's input. What a stage
    has written on the way goes when it is done, its input then too; the last result stays until the process ends."""
    docs = table(spark, sf_dir, "documents")
    where = f"{scratch_root(spark)}/corpus-{uuid.uuid4().hex}"
    keep_until_exit(spark, where)
    for k, (_, stage) in enumerate(STAGES):
        with swept(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
        if k:
            remove(spark, f"{where}/{k - 1}")
    return docs

"""Ranked retrieval over a block inverted index: BM25 and counts of shared terms, exact, with impact bounds.

The index is a written table. Documents are cut into blocks; a row holds the postings of one term in one block, and a row
of the empty term the block's documents and their lengths. A search reads the rows of the terms that are asked for, joins
them to blocks of queries on the cluster, and takes each query's terms from the largest bound on their gain to the smallest:
once what is left cannot lift a new document over the k-th score so far, only documents that still can get there are looked up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import BM25_TOKEN, tokens
from tessera.sources.scratch import arrow_rows, written

#: Documents of a block, tokens at which it is closed before, and query terms of a block of queries: what a task holds at once.
BLOCK_DOCUMENTS, BLOCK_TOKENS, QUERY_TERMS = 2_048, 4_000_000, 50_000
#: Scores are rounded and ties broken later, so what is this close to the k-th score is passed on.
SLACK = 1e-5


def build_index(docs: DataFrame, doc_key: str = "doc_id", text: str = "text", pattern: str = BM25_TOKEN, documents: int = BLOCK_DOCUMENTS) -> DataFrame:
    """(block, term, places, tf, keys, dl): the postings of every term by block, ready to be written.

    Documents of a null or empty text have no token and count as documents. Keys may be of any type; rows of one key are
    documents of their own. Tokens are found once, and a task holds one block's of at most `documents`.
    """
    source = docs.select(F.col(doc_key).alias("key"), tokens(F.col(text), pattern).alias("t"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], [0, 0]

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal number
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            size[:] = [0, 0]
            lists = table["t"].chunk(0) if table.num_rows else pa.array([], pa.list_(pa.string()))
            keys = table["key"].combine_chunks()
            dl = np.diff(lists.offsets.to_numpy()).astype(np.int32)
            coded = lists.flatten().dictionary_encode()
            del table, lists
            # sorted in place: a full block has millions of tokens, and each array of them is many MB
            cell = coded.indices.to_numpy().astype(np.int64)
            dictionary = coded.dictionary
            del coded
            cell *= len(dl)
            cell += np.repeat(np.arange(len(dl), dtype=np.int32), dl)
            cell.sort()
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
            tf = np.diff(np.r_[first, len(cell)]).astype(np.int32)
            cell = cell[first]
            del first
            term = (cell // max(1, len(dl))).astype(np.int32)
            cell -= term.astype(np.int64) * len(dl)
            place = cell.astype(np.int32)
            del cell
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
            offsets = pa.array(np.r_[starts, len(term)], pa.int32())
            fields = ["block", "term", "places", "tf", "keys", "dl"]
            keys_type, dl_type = pa.list_(keys.type), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([""]), pa.array([[]], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int32())),
                pa.ListArray.from_arrays(pa.array([0, len(dl)], pa.int32()), keys).cast(keys_type), pa.ListArray.from_arrays(pa.array([0, len(dl)], pa.int32()), pa.array(dl)),
            ], fields)
            for a in range(0, len(starts), 20_000):
                z = min(a + 20_000, len(starts))
                part = offsets.slice(a, z - a + 1)
                own = pa.array(part.to_numpy() - part[0].as_py(), pa.int32())
                span = slice(part[0].as_py(), part[-1].as_py())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(z - a, number)), dictionary.take(pa.array(term[starts[a:z]])),
                    pa.ListArray.from_arrays(own, pa.array(place[span])), pa.ListArray.from_arrays(own, pa.array(tf[span])),
                    pa.nulls(z - a, keys_type), pa.nulls(z - a, dl_type),
                ], fields)
            number += 1

        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, documents - size[0])
                held.append(part)
                at += part.num_rows
                size[0] += part.num_rows
                size[1] += len(part.column(1).flatten())
                if size[0] >= documents or size[1] >= BLOCK_TOKENS:
                    yield from close()
        if held:
            yield from close()

    schema = f"block long, term string, places array<int>, tf array<int>, keys array<{kind}>, dl array<int>"
    return source.mapInArrow(run, schema)


def statistics(index: DataFrame) -> tuple[int, float]:
    """Number of documents and their mean length; 1.0 where there is none."""
    sizes = index.filter("term = ''").agg(F.sum(F.size("dl")).alias("n"), F.sum(F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")).first()
    return sizes["n"] or 0, (sizes["total"] or 0) / sizes["n"] if sizes["n"] else 1.0


def idf(index: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(query, term, weight) of the asked terms that occur at all."""
    df = index.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    return asked.join(df, "term").withColumn("weight", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))).drop("df")


def _best(places: list[np.ndarray], gains: list[np.ndarray], bounds: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, postings looked at) of the documents of a block that may be among a query's k best."""
    order = np.argsort(-bounds, kind="stable")
    rest = np.r_[np.cumsum(bounds[order][::-1])[::-1], 0.0]
    score, looked, floor = np.zeros(size), 0, 0.0
    for i, t in enumerate(order.tolist()):
        if rest[i] < floor - SLACK:
            break
        score[places[t]] += gains[t]
        looked += len(places[t])
        if i + 1 < len(order) and size > k and rest[i + 1] < score.max():
            floor = np.partition(score, -k)[-k]
    else:
        i = len(order)
    near = np.flatnonzero((score > 0) & (score + rest[i] >= floor - SLACK))
    left = score[near]
    for t in order[i:].tolist():
        at = np.minimum(np.searchsorted(places[t], near), len(places[t]) - 1)
        same = places[t][at] == near
        left[same] += gains[t][at[same]]
        looked += len(near)
    least = np.partition(left, -k)[-k] if len(left) > k else 0.0
    kept = left >= least - SLACK
    return near[kept], left[kept], looked


def search(index: DataFrame, asked: DataFrame, k: int, gain, query_key: str, doc_key: str, digits: int, measure: bool = False) -> DataFrame:
    """(query, doc, score, rank) of the k best documents of each query; equal scores go to the smaller key.

    asked: (query, term, weight), distinct; gain(tf, dl) is numpy code and weight * gain must not be negative. Queries are cut
    into blocks of about QUERY_TERMS terms by a hash; a block of documents meets a block of queries in one task, which holds
    only postings of terms that the queries ask for. measure: rows (postings, looked) by task instead, of what the bounds spare.
    """
    # null queries are queries like others; the number of blocks follows from the counted terms
    blocks = max(1, math.ceil(asked.count() / QUERY_TERMS))
    part = F.pmod(F.xxhash64(query_key), F.lit(blocks)).alias("part")
    wanted = asked.select(part, F.col(query_key).alias("q"), "term", "weight")
    packed = wanted.groupBy("part").agg(F.collect_list(F.struct("q", "term", "weight")).alias("asked"))
    terms = wanted.select("part", "term").distinct()
    needed = index.filter("term <> ''").join(terms, "term").select("block", "part", "term", "places", "tf")
    heads = index.filter("term = ''").select("block", "keys", "dl")
    q_type, key_type = asked.schema[query_key].dataType, index.schema["keys"].dataType.elementType
    # a block's documents and a block of queries stand before the postings of their pair
    pairs = heads.crossJoin(F.broadcast(packed)) if blocks == 1 else heads.join(needed.select("block", "part").distinct(), "block").join(packed, "part")
    first = pairs.select("block", "part", F.lit("").alias("term"), F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<int>").alias("tf"), "keys", "dl", "asked")
    rest = needed.select("*", F.lit(None).cast(index.schema["keys"].dataType).alias("keys"), F.lit(None).cast("array<int>").alias("dl"), F.lit(None).cast(packed.schema["asked"].dataType).alias("asked"))
    met = first.unionByName(rest).repartition("block", "part").sortWithinPartitions("block", "part", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = dl = asked_rows = None
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def done() -> Iterator[pa.RecordBatch]:
            queries, at, scores = [], [], []
            of: dict = {}
            for q, t, w in zip(asked_rows.field("q").to_pylist(), asked_rows.field("term").to_pylist(), asked_rows.field("weight").to_pylist(), strict=True):
                if t in held:
                    of.setdefault(q, []).append((t, w))
            most = {t: float(g.max()) for t, (_, g) in held.items()}
            looked = 0
            for q, mine in of.items():
                bounds = np.array([w * most[t] for t, w in mine])
                d, s, seen = _best([held[t][0] for t, _ in mine], [w * held[t][1] for t, w in mine], bounds, len(dl), k)
                looked += seen
                queries += [q] * len(d)
                at.append(d)
                scores.append(s)
            total = sum(len(held[t][0]) for mine in of.values() for t, _ in mine)
            held.clear()
            if measure:
                yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([looked])], ["postings", "looked"])
            elif queries:
                yield pa.RecordBatch.from_arrays([pa.array(queries, asked_rows.field("q").type), keys.take(pa.array(np.concatenate(at))), pa.array(np.concatenate(scores))], ["q", "key", "score"])

        for b in batches:
            column = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            names = column["term"].to_pylist()
            ends = column["places"].offsets.to_numpy(), column["tf"].offsets.to_numpy()
            flat = column["places"].values.to_numpy(), column["tf"].values.to_numpy()
            for i, t in enumerate(names):
                if t == "":
                    if dl is not None:
                        yield from done()
                    keys, dl, asked_rows = column["keys"][i].values, column["dl"][i].values.to_numpy(), column["asked"][i].values
                else:
                    p, f = (flat[n][ends[n][i] : ends[n][i + 1]] for n in (0, 1))
                    held[t] = p.copy(), gain(f, dl[p])
        if dl is not None:
            yield from done()

    if measure:
        return met.mapInArrow(run, "postings long, looked long")
    scored = met.mapInArrow(run, f"q {q_type.simpleString()}, key {key_type.simpleString()}, score double").toDF(query_key, doc_key, "score")
    scored = scored.withColumn("score", F.round("score", digits)).filter("score > 0")
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(doc_key))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def asked_terms(queries: DataFrame, query_key: str, text: str, least_chars: int = 1) -> DataFrame:
    """(query, term): the distinct terms of each query that have least_chars or more characters."""
    return queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).filter(F.length("term") >= least_chars).distinct()


def bm25_gain(avgdl: float, k1: float = 1.2, b: float = 0.75):
    return lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def only(index: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of an index that a search of these terms reads; one pass over an index that is not written yet, as its blocks are
    numbered by the task that makes them."""
    terms = asked.select("term").unionByName(asked.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
    return index.join(terms, "term", "left_semi").select(*index.columns)


def _asked_index(docs: DataFrame, asked: DataFrame, doc_key: str, text: str) -> DataFrame:
    """The written index of the asked terms; the words of one block's documents at most come to a task at once."""
    with arrow_rows(docs.sparkSession, BLOCK_DOCUMENTS):
        return written(only(build_index(docs, doc_key, text), asked), "index")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 20, doc_key: str = "doc_id", query_key: str = "item_id", text: str = "text", k1: float = 1.2, b: float = 0.75, digits: int = 6, index: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank) of the k best documents per query; equal scores go to the smaller document key.

    Query terms are distinct. index: a written index of docs, for searches that come again; else one of the asked terms is
    written for this search.
    """
    asked = written(asked_terms(queries, query_key, text), "asked")
    index = index if index is not None else _asked_index(docs, asked, doc_key, text)
    n, avgdl = statistics(index)
    weighted = written(idf(index, asked, n), "weights")
    return search(index, weighted, k, bm25_gain(avgdl, k1, b), query_key, doc_key, digits)


def shared_terms(docs: DataFrame, queries: DataFrame, k: int = 20, least_chars: int = 1, doc_key: str = "doc_id", query_key: str = "item_id", text: str = "text", index: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank) of the k documents per query with most of its distinct terms of least_chars or more characters."""
    asked = written(asked_terms(queries, query_key, text, least_chars).withColumn("weight", F.lit(1.0)), "asked")
    index = index if index is not None else _asked_index(docs, asked, doc_key, text)
    return search(index, asked, k, lambda tf, dl: np.minimum(tf, 1), query_key, doc_key, 0)

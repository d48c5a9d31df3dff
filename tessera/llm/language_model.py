"""Language-model scores of whole documents: a recurrent model trained in shards on the cluster, over exact word counts.

Tokens are words, A-Z lower-cased, and an end. All training documents are counted. The most frequent words, whose number
grows with the cube root of the counted tokens, have vectors and output classes of their own; every other word belongs to a
tail class by its ending, where its probability is its smoothed share of the class. Counts of the most frequent words are
held by every worker; those of rarer words are joined to the documents by word hash, so each count is exact.

Every training document trains the recurrent part, in one of ROUNDS rounds and in one of the round's shards, both by its
hash: how the table is partitioned has no say in it. Each shard trains a copy by truncated backpropagation; copies are
averaged by their tokens after each round. A document's state starts at zero and is carried across windows to its end.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import crc_bucket, materialize, single_threaded, small_batches

#: Words whose counts every worker holds at least; the rest is joined. Words with vectors by cube root of tokens; tail classes.
KNOWN, WORDS, TAILS = 120_000, 8, 16
#: Rounds of averaging; tokens of a shard at least, by itself and by parameter (so that copies stay small against the input).
ROUNDS, SHARD, SHARD_BY_PARAMETER = 3, 1_000_000, 4
#: Tokens pooled for training and for scoring; a longer document trains in parts of so many tokens, each from the zero state.
POOL, SCORED, PART = 1_000_000, 4_000_000, 4096
#: Floats in a segment of a copy's parameters; segments are averaged apart.
SEGMENT = 1 << 16
END = b""


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(hash, word, c) over all tokens of docs; the end's word is empty. Null texts have an end only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(list(map(word_hash, part)), pa.int64()), pa.array(part, pa.binary()), pa.array(list(map(counts.__getitem__, part)), pa.int64())], ["hash", "word", "c"])
            counts.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(words_of(t))
            if b.num_rows:
                counts[END] += b.num_rows
            if len(counts) > 400_000:
                yield from rows()
        yield from rows()

    each = docs.select(F.col(text).alias("t")).mapInArrow(run, "hash long, word binary, c long")
    return each.groupBy("hash", "word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """rank: the most frequent words by rank; counts: theirs; head: how many of them have vectors. tail_n and tail_v: tokens
    and words of the tail classes."""

    rank: dict[bytes, int]
    counts: np.ndarray
    head: int
    tokens: int
    distinct: int
    tail_n: np.ndarray
    tail_v: np.ndarray

    @property
    def end(self) -> int:
        """Input number of the end, also the input before the first word."""
        r = self.rank.get(END, self.head)
        return r if r < self.head else self.head + tail_of(END)

    @property
    def kind(self) -> str:
        return "<u2" if self.head + TAILS < 1 << 16 else "<u4"

    def inputs_of(self) -> np.ndarray:
        """Input number of each rank."""
        out = np.arange(len(self.counts))
        for w, r in self.rank.items():
            if r >= self.head:
                out[r] = self.head + tail_of(w)
        return out


@dataclass
class Model:
    vocabulary: Vocabulary
    shape: gru.Shape
    params: dict[str, np.ndarray]


class _Ranks(dict):
    """Rank of a known word; -1 - tail class of any other."""

    def __missing__(self, word: bytes) -> int:
        return -1 - tail_of(word)


def vocabulary_of(counts: DataFrame) -> Vocabulary:
    """counts: count_words of the training documents."""
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total["n"] or 0, total["v"]
    head = min(distinct, math.ceil(WORDS * tokens ** (1 / 3)))
    # how often each count occurs says from which count on all words fit; ties at the bound are left to the join
    least, room = 1, max(KNOWN, head)
    for r in counts.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c")).toLocalIterator():
        if r["words"] > room:
            least = r["c"] + 1
            break
        room -= r["words"]
    held = counts.filter(F.col("c") >= least).select("word", "c").toArrow()
    top = sorted(zip(held["word"].to_pylist(), held["c"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    del held
    head = min(head, len(top))
    first = [w for w, _ in top[:head]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, v, skip = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64), set(first)
        for b in batches:
            for w, c in zip(b["word"], b["c"], strict=True):
                if bytes(w) not in skip:
                    n[tail_of(bytes(w))] += c
                    v[tail_of(bytes(w))] += 1
        yield pd.DataFrame({"k": np.arange(TAILS), "n": n, "v": v})

    tail_n, tail_v = np.zeros(TAILS, np.int64), np.zeros(TAILS, np.int64)
    for r in counts.select("word", "c").mapInPandas(run, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        tail_n[r["k"]], tail_v[r["k"]] = r["n"], r["v"]
    return Vocabulary({w: k for k, (w, _) in enumerate(top)}, np.array([c for _, c in top], np.int64), head, tokens, distinct, tail_n, tail_v)


def untrained(vocabulary: Vocabulary) -> Model:
    """A model that gives each word its smoothed share of the counts."""
    v = vocabulary
    words = v.counts[: v.head] if v.head else np.zeros(1, np.int64)
    shape = gru.Shape(gru.bounds_of(words, max(1, round(0.6 * math.sqrt(len(words))))), TAILS)
    return Model(v, shape, gru.start(shape, np.r_[words, v.tail_n]))


def shards_of(model: Model) -> int:
    """Shards of a round, by the counted tokens and the model's size only."""
    return max(1, round(model.vocabulary.tokens / ROUNDS / max(SHARD, SHARD_BY_PARAMETER * sum(x.size for x in model.params.values()))))


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str, text: str, trains: Column, shards: int = 1) -> DataFrame:
    """Documents as input numbers, written: (row, key, n_tokens, n_known, base, inner, round, shard, place, ids, hashes, ns). round is
    null where trains is not true. Known counts are in base and, as shares of their tail classes, in inner; hashes and ns are the
    words whose counts are joined, and how often each occurs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[key].dataType.simpleString()
    columns = ["row", "key", "n_tokens", "n_known", "base", "inner", "round", "shard", "place", "ids", "hashes", "ns"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        ranks, inputs = _Ranks(v.rank), np.r_[v.inputs_of(), v.head + np.arange(TAILS)[::-1]].astype(v.kind)
        # an unknown word's rank -1 - k looks up tail class k from the end of inputs
        log_c = np.r_[np.log10(v.counts + 0.1), np.zeros(TAILS)]
        log_all = math.log10(v.tokens + 0.1 * (v.distinct + 1))
        # what a token adds to inner: its count, where it is known, and its class in any case; words with vectors add nothing
        log_tail = np.log10(v.tail_n + 0.1 * (v.tail_v + 1))
        within = np.where(inputs >= v.head, log_c - log_tail[np.maximum(inputs.astype(np.int64) - v.head, 0)], 0.0)
        row, met, end = TaskContext.get().partitionId() << 36, {}, [END]
        for b in batches:
            main = []
            for k, name, t, train in zip(b["k"], b["name"], b["t"], b["train"], strict=True):
                raw = (t or "").encode("utf-8", "replace")
                words = raw.lower().split() + end
                r = np.fromiter(map(ranks.__getitem__, words), np.int32, len(words))
                unknown = np.flatnonzero(r < 0)
                base = float(log_c[r].sum()) - len(words) * log_all
                rare = Counter([words[i] for i in unknown.tolist()])
                n, shard, h = None, None, None
                if train:
                    # a repeated row is a document of its own: its repeats are dealt out too
                    h = xxhash.xxh3_64_intdigest(raw, xxhash.xxh3_64_intdigest(str(name).encode()))
                    met[h] = again = met.get(h, 0) + 1
                    h = xxhash.xxh3_64_intdigest(again.to_bytes(8, "little"), h) if again > 1 else h
                    n, shard, h = h % ROUNDS, h // ROUNDS % shards, h >> 1
                main.append((row, k, len(words), len(words) - len(unknown), base, float(within[r].sum()), n, shard, h, inputs[r].tobytes(), [word_hash(w) for w in rare], list(rare.values())))
                row += 1
            if len(met) > 1_000_000:
                met.clear()
            yield pd.DataFrame(main, columns=columns, dtype=object)

    each = docs.select(F.col(key).alias("k"), F.col(key).cast("string").alias("name"), F.col(text).alias("t"), F.coalesce(trains, F.lit(False)).alias("train"))
    schema = f"row long, key {kind}, n_tokens long, n_known long, base double, inner double, round int, shard int, place long, ids binary, hashes array<long>, ns array<int>"
    return materialize(each.mapInPandas(run, schema), "encoded")


def _averaged(copies: DataFrame, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Mean of copies (seg, weight, blob) by weight, summed by segment on the cluster; like where there are no copies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        weight: dict[int, float] = {}
        for b in batches:
            for seg, w, blob in zip(b["seg"], b["weight"], b["blob"], strict=True):
                x = np.frombuffer(blob, np.float32) * np.float64(w)
                total[seg] = total[seg] + x if seg in total else x
                weight[seg] = weight.get(seg, 0.0) + w
        yield pd.DataFrame({"seg": list(total), "blob": [(x / weight[s]).astype(np.float32).tobytes() for s, x in total.items()]}, dtype=object)

    flat = gru.pack(like)
    for r in copies.repartition("seg").mapInPandas(run, "seg int, blob binary").toLocalIterator():
        x = np.frombuffer(r["blob"], np.float32)
        flat[r["seg"] * SEGMENT : r["seg"] * SEGMENT + len(x)] = x
    return gru.unpack(flat, like)


def train(model: Model, encoded: DataFrame, shards: int) -> Model:
    """model after ROUNDS rounds over the encoded training documents."""
    spark, v, shape, params = encoded.sparkSession, model.vocabulary, model.shape, model.params
    for n in range(ROUNDS):
        shared = spark.sparkContext.broadcast(params)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            now, trainer, pool, held, seen = None, None, [], 0, 0

            def copy() -> Iterator[pd.DataFrame]:
                trainer.train(pool, v_end)
                flat = gru.pack(trainer.p)
                for seg in range(-(-len(flat) // SEGMENT)):
                    yield pd.DataFrame({"seg": [seg], "weight": [float(seen)], "blob": [flat[seg * SEGMENT : (seg + 1) * SEGMENT].tobytes()]}).astype({"blob": object})

            for b in batches:
                for shard, ids in zip(b["shard"], b["ids"], strict=True):
                    if shard != now:
                        if trainer is not None:
                            yield from copy()
                        now, trainer, pool, held, seen = shard, gru.Trainer(shared.value, shape), [], 0, 0
                    x = np.frombuffer(ids, v_kind).astype(np.int32)
                    pool += [x[at : at + PART] for at in range(0, len(x), PART)]
                    held, seen = held + len(x), seen + len(x)
                    if held > POOL:
                        trainer.train(pool, v_end)
                        pool, held = [], 0
            if trainer is not None:
                yield from copy()

        v_end, v_kind = v.end, v.kind
        mine = encoded.filter(F.col("round") == n).select("shard", "place", "ids").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place")
        params = _averaged(mine.mapInPandas(run, "seg int, weight double, blob binary"), params)
        shared.unpersist()
    return Model(v, shape, params)


def fit(docs: DataFrame, counts: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model of the training documents docs; counts: count_words of the same."""
    model = untrained(vocabulary_of(counts))
    shards = shards_of(model)
    return train(model, encode(docs, model.vocabulary, key, text, F.lit(True), shards), shards)


def _scored(encoded: DataFrame, model: Model, counts: DataFrame, key: str) -> DataFrame:
    shape = model.shape
    end, kind = model.vocabulary.end, model.vocabulary.kind
    shared = encoded.sparkSession.sparkContext.broadcast(model.params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool, held = [], 0

        def done() -> pd.DataFrame:
            rows = pd.concat(pool, ignore_index=True)
            docs_ = [np.frombuffer(x, kind).astype(np.int32) for x in rows["ids"]]
            per_token = gru.token_log10(shared.value, shape, docs_, end)
            sums = np.add.reduceat(per_token, np.r_[0, np.cumsum([len(d) for d in docs_])[:-1]])
            pool.clear()
            return rows.drop(columns="ids").assign(score=sums + rows["inner"].to_numpy(float)).drop(columns="inner")

        for b in batches:
            if len(b):
                pool.append(b)
                held += int(b["n_tokens"].sum())
            if held > SCORED:
                yield done()
                held = 0
        if pool:
            yield done()

    main = encoded.select("row", "key", "n_tokens", "n_known", "base", "inner", "ids")
    scored = main.mapInPandas(run, f"row long, key {encoded.schema['key'].dataType.simpleString()}, n_tokens long, n_known long, base double, score double")
    rare = encoded.select("row", F.explode(F.arrays_zip("hashes", "ns")).alias("w")).select("row", F.col("w.hashes").alias("hash"), F.col("w.ns").alias("n"))
    rare = rare.join(counts.select("hash", "c"), "hash", "left")
    c = F.coalesce("c", F.lit(0))
    more = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(c + F.lit(0.1).cast("double"))).alias("more"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"))
    zero = F.lit(0.0).cast("double")
    return scored.join(more, "row", "left").select(
        F.col("key").alias(key),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        (F.col("base") + F.coalesce("more", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more", zero)).alias("score"),
    )


def score(docs: DataFrame, model: Model, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, base_score, score): log10 probabilities of whole texts by the counts alone and by the model."""
    return _scored(encode(docs, model.vocabulary, key, text, F.lit(False)), model, counts, key)


def held_out_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", held_out_of: int = 10) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    Rows whose crc32(key as text) is divisible by held_out_of are scored only, all others train too (a null key trains).
    Null and empty texts have an end and no word. Repeated rows are counted, train and are scored each. Without training rows
    every token is unknown. Only key and text are read. Scores depend on rows, not on partitions: copies of one row may
    be dealt to other shards when they lie in other partitions, and floats are summed in another order.
    """
    small_batches(docs.sparkSession)
    mine = docs.select(key, text)
    trains = F.coalesce(crc_bucket(F.col(key), held_out_of) != 0, F.lit(True))
    with single_threaded(docs.sparkSession):
        counts = materialize(count_words(mine.filter(trains), text), "words")
        model = untrained(vocabulary_of(counts))
        shards = shards_of(model)
        encoded = encode(mine, model.vocabulary, key, text, trains, shards)
        model = train(model, encoded, shards)
        out = _scored(encoded, model, counts, key)
    held_out = F.coalesce(crc_bucket(F.col(key), held_out_of) == 0, F.lit(False))
    return out.select(key, held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")

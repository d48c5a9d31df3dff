"""A factorisation machine that scores text quality: hashed words, structure statistics and metadata with pairwise interactions.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j); the pair sum is computed in linear time as half of
the square of the sum minus the sum of the squares, factor by factor.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, small_batches

#: Buckets of hashed words, statistics of a text's structure, factors. At most SAMPLE labelled rows train the model.
WORDS, FACTORS, SAMPLE = 1 << 14, 8, 6000
_SPACES, _SYMBOLS, _MARKS = (np.zeros(256, bool) for _ in range(3))
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_SYMBOLS[list(b"#*$%&|<>")] = True
_MARKS[list(b".,;:!?")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def statistics(raw: bytes, words: list[bytes], n_chars: float) -> list[float]:
    """Shares and logarithms, each about 0 to 3. n_chars is the metadata column; the text's own length where it is null."""
    n, size = max(1, len(words)), max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    ink = max(1, size - int(counts[_SPACES].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        1.0,
        np.log1p(len(words)) / 5,
        np.log1p(max(0.0, n_chars)) / 5,
        ink / n / 5,
        len(set(words)) / n,
        min(3.0, counts[_SYMBOLS].sum() / n),
        min(3.0, counts[_MARKS].sum() / n),
        min(3.0, counts[33] / n),
        counts[_UPPER].sum() / ink,
        counts[_DIGIT].sum() / ink,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        np.log1p(len(lines)) / 3,
        counts[128:].sum() / ink,
        min(3.0, max(map(len, words), default=0) / 30),
    ]


STATISTICS = len(statistics(b"", [], 0.0))


class Features:
    """Numbers and values of a text's features; words come first, by hash, weighted to length 1."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def of(self, text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
        raw = (text or "").encode("utf-8", "replace")
        words = raw.lower().split()
        if len(self.memo) > 400_000:
            self.memo.clear()
        memo = self.memo
        for w in set(words):
            if w not in memo:
                memo[w] = zlib.crc32(w) % WORDS
        at, n = np.unique(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)), return_counts=True)
        x = np.log1p(n)
        x = x / max(1e-9, float(np.sqrt((x * x).sum())))
        meta = len(text or "") if n_chars is None or n_chars != n_chars else float(n_chars)
        return np.r_[at, WORDS + np.arange(STATISTICS)], np.r_[x, statistics(raw, words, meta)]


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        s = x @ self.v[at]
        return float(self.w0 + self.w[at] @ x + 0.5 * ((s * s).sum() - ((x * x) @ (self.v[at] ** 2)).sum()))


def probability(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 5) -> Machine:
    """Logistic loss by Adagrad in mini-batches. With labels of one kind only, the machine is its smoothed share."""
    rng = np.random.default_rng(seed)
    n = WORDS + STATISTICS
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(n), rng.standard_normal((n, FACTORS)) * 0.02)
    if len(set(labels.tolist())) < 2:
        m.v[:] = 0
        return m
    gw, gv, g0 = np.full(n, 1e-4), np.full((n, FACTORS), 1e-4), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            at = np.concatenate([rows[i][0] for i in own])
            x = np.concatenate([rows[i][1] for i in own])
            ends = np.r_[0, np.cumsum([len(rows[i][0]) for i in own])[:-1]]
            doc = np.repeat(np.arange(len(own)), [len(rows[i][0]) for i in own])
            vx = m.v[at] * x[:, None]
            s = np.add.reduceat(vx, ends)
            margin = m.w0 + np.add.reduceat(m.w[at] * x, ends) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat(vx * vx, ends).sum(axis=1))
            e = (probability(margin) - labels[own]) / len(own)
            dw = np.bincount(at, e[doc] * x, n) + decay * m.w
            dv_rows = (e[doc] * x)[:, None] * (s[doc] - vx)
            dv = np.stack([np.bincount(at, dv_rows[:, f], n) for f in range(FACTORS)], axis=1) + decay * m.v
            g0 += float(e.sum()) ** 2
            gw += dw * dw
            gv += dv * dv
            m.w0 -= rate * float(e.sum()) / np.sqrt(g0)
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= rate * dv / np.sqrt(gv)
    return m


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", chars: str = "n_chars", sample: int = SAMPLE) -> Machine:
    """Trains on at most `sample` labelled rows, the first by a hash of their key; keys with several labels count by the larger."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("__y"))
    chosen = known.orderBy(F.xxhash64(F.col(key)), key).limit(sample).collect()
    if not chosen:
        return Machine(0.0, np.zeros(WORDS + STATISTICS), np.zeros((WORDS + STATISTICS, FACTORS)))
    ids = docs.sparkSession.createDataFrame([(r[key], int(r["__y"])) for r in chosen], f"{key} {labels.schema[key].dataType.simpleString()}, __y int")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        features = Features()
        for b in batches:
            found = [features.of(t, c) for t, c in zip(b["t"], b["c"], strict=True)]
            out = pd.DataFrame({"k": b["k"], "y": b["y"], "at": [f[0].astype(np.int32).tobytes() for f in found], "x": [f[1].tobytes() for f in found]})
            yield out.astype({"at": object, "x": object})

    # the ids are at most `sample` rows, so they are broadcast
    picked = docs.join(F.broadcast(ids), key).select(F.col(key).alias("k"), F.col(text).alias("t"), _chars(docs, chars).alias("c"), F.col("__y").alias("y"))
    rows = picked.mapInPandas(run, f"k {docs.schema[key].dataType.simpleString()}, y int, at binary, x binary").collect()
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r["k"]).encode()), str(r["k"]), r["at"]))
    return train([(np.frombuffer(r["at"], np.int32).astype(np.int64), np.frombuffer(r["x"])) for r in rows], np.array([r["y"] > 0 for r in rows], float))


def _chars(docs: DataFrame, chars: str):
    return F.col(chars).cast("double") if chars in docs.columns else F.lit(None).cast("double")


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """(key, score): probability of label 1 for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, features = shared.value, Features()
        for b in batches:
            margins = np.array([machine.margin(*features.of(t, c)) for t, c in zip(b["t"], b["c"], strict=True)], float)
            yield pd.DataFrame({"k": b["k"], "s": probability(margins)})

    got = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), _chars(docs, chars).alias("c")).mapInPandas(run, f"k {kind}, s double")
    return got.select(F.col("k").alias(key), F.col("s").alias("score"))


def held_out_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """(key, held_out, score, predicted) for every row of docs; labels of keys with crc32(key as text) mod 4 = 2 are never read.

    Null and empty texts are scored by their statistics. Null keys are scored and not held out. Without labels every score is
    one half. Repeated rows get equal scores. Of docs only key, text and n_chars (optional) are read, of labels key and label.
    """
    small_batches(docs.sparkSession)
    machine = fit(docs, labels.filter(crc_bucket(F.col(key), 4) != 2), key, text, label)
    out = score(docs, machine, key, text)
    held_out = F.coalesce(crc_bucket(F.col(key), 4) == 2, F.lit(False))
    return out.select(key, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

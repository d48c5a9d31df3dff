"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text is cut before words where the gear hash of the 16 bytes before falls below a bound, so an insertion moves the cuts
near it only and a passage has the same chunks wherever it stands. A run is the shortest row of chunks from or up to a chunk
that has min_words words; one that an earlier document has as a whole (or that stands earlier in its own document) is a
repeat and is removed. Shorter repeats stay: in ordinary prose a few words return by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import materialize, small_batches
from .shingles import mix

#: One word in five begins a chunk. Stretches over LONG bytes without a cut are cut at words or, without blanks, characters, one in 64, and at last by length.
WORDS_PER_CHUNK, LONG, CHARACTERS_PER_CHUNK = 5, 512, 64
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(raw: np.ndarray) -> np.ndarray:
    """Gear hash modulo 2^16 after each byte: h = 2 h + GEAR[byte], so it depends on the last 16 bytes."""
    h = GEAR[raw]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    return h


def cuts(raw: bytes) -> np.ndarray:
    """Ends of the chunks of a text in bytes: 0, then the start of every further chunk, then the length."""
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    if n < 2:
        return np.array([0, n][: n + 1])
    h, space = gear(b), _SPACE[b]
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    at = np.r_[0, starts[h[starts] < 65536 // WORDS_PER_CHUNK] + 1, n]
    for bound in (65536 // CHARACTERS_PER_CHUNK, 65536):
        wide = np.flatnonzero(np.diff(at) > LONG)
        more = []
        for k in wide:
            lo, hi = int(at[k]) + 1, int(at[k + 1])
            words = starts[(starts >= lo) & (starts < hi - 1)] + 1
            lead = words if len(words) else lo + np.flatnonzero((b[lo:hi] & 0xC0) != 0x80)
            if bound < 65536:
                more.append(lead[h[lead - 1] < bound])
            elif len(lead):
                more.append(lead[np.searchsorted(lead, np.arange(lo + LONG, hi, LONG)).clip(max=len(lead) - 1)])
        if more:
            at = np.unique(np.r_[at, np.concatenate(more)])
    return at


def digests(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Signed 64-bit digest of each chunk without white space at its end."""
    ends = at.tolist()
    return np.array([xxhash.xxh3_64_intdigest(raw[a:z].rstrip()) for a, z in zip(ends, ends[1:], strict=False)], np.uint64).view(np.int64)


#: Odd, so that it has an inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15


def runs(raw: bytes, at: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from chunk, to chunk, signed digest) of the runs of a text, by place: from each chunk on and up to each chunk.

    A long stretch without blanks counts by its bytes. The digest is of the chunks' digests in order.
    """
    b, d = np.frombuffer(raw, np.uint8), digests(raw, at).view(np.uint64)
    m = len(d)
    space = _SPACE[b]
    begins = ~space & np.r_[True, space[:-1]]
    words = np.r_[0, np.cumsum(begins)][at]
    k = np.arange(m + 1)
    stop = np.minimum(np.searchsorted(words, words + min_words), np.searchsorted(at, at + 16 * min_words))
    start = np.maximum(np.searchsorted(words, words - min_words, "right"), np.searchsorted(at, at - 16 * min_words, "right")) - 1
    on, back = stop <= m, start >= 0
    lo, hi = np.divmod(np.unique(np.r_[k[on] * (m + 1) + stop[on], start[back] * (m + 1) + k[back]]), m + 1)
    power = np.cumprod(np.r_[np.uint64(1), np.full(m, _BASE, np.uint64)])
    inverse = np.cumprod(np.r_[np.uint64(1), np.full(m, pow(_BASE, -1, 1 << 64), np.uint64)])
    total = np.r_[np.uint64(0), np.cumsum(d * power[:m])]
    return lo, hi, mix((total[hi] - total[lo]) * inverse[lo] + (hi - lo).astype(np.uint64)).view(np.int64)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def _runs(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(digest, id, n): each different run of a document and how often it has it."""
    whole = isinstance(docs.schema[key].dataType, IntegralType)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found, ids, counts = [], [], []
            for i, t in zip(b["id"], b["t"], strict=True):
                raw = _bytes(t)
                d, n = np.unique(runs(raw, cuts(raw), min_words)[2], return_counts=True) if raw.strip() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                found.append(d)
                counts.append(n)
                ids += [i] * len(d)
            if found:
                yield pd.DataFrame({"digest": np.concatenate(found), "id": ids if whole else pd.Series(ids, dtype=object), "n": np.concatenate(counts)})

    kind = docs.schema[key].dataType.simpleString()
    return docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t")).mapInPandas(run, f"digest long, id {kind}, n int")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 16) -> DataFrame:
    """(id, later, own): digests of a document's runs that an earlier document has, and of those it is the first to have but has twice."""
    found = _runs(docs, key, text, min_words)
    many = materialize(found.groupBy("digest").agg(F.min("id").alias("first"), F.sum("n").alias("c")).filter("c > 1").select("digest", "first"), "repeated")
    marked = found.join(many, "digest").filter("id <> first or n > 1")
    return marked.groupBy("id").agg(F.collect_list(F.when(F.col("id") != F.col("first"), F.col("digest"))).alias("later"), F.collect_list(F.when(F.col("id") == F.col("first"), F.col("digest"))).alias("own"))


def dedup(docs: DataFrame, min_words: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text rid of repeats, and n_words and removed_words (long, of the whole text) and spans (array of start and
    stop, in characters of the whole text).

    The first holder of a passage is the document with the smallest key, and in it the first place. Null, empty and blank
    texts are left as they are. Rows of one key count as one document; rows of a null key are left as they are and mark
    nothing. Columns of the added names are replaced; all others pass through.
    """
    small_batches(docs.sparkSession)
    marks = materialize(repeats(docs, key, text, min_words), "marks")
    rest = [c for c in docs.columns if c not in (text, "n_words", "removed_words", "spans")]
    put = {"__t": F.col(text), "__later": F.col("__repeated"), "__own": F.col("__first")}
    joined = docs.join(marks.toDF("__id", "__repeated", "__first"), F.col(key) == F.col("__id"), "left").select(*rest, *[c.alias(n) for n, c in put.items()])

    def clean(t: str | None, later: np.ndarray | None, own: np.ndarray | None) -> tuple[str | None, int, int, list[tuple[int, int]]]:
        raw = _bytes(t)
        total = len(raw.split())
        if later is None or not total:
            return t, total, 0, []
        at = cuts(raw)
        lo, hi, d = runs(raw, at, min_words)
        hit = np.isin(d, later)
        if len(own):
            first = np.zeros(len(d), bool)
            first[np.unique(d, return_index=True)[1]] = True
            hit |= np.isin(d, own) & ~first
        depth = np.bincount(lo[hit], minlength=len(at)) - np.bincount(hi[hit], minlength=len(at))
        edge = np.flatnonzero(np.diff(np.r_[False, np.cumsum(depth)[:-1] > 0, False].astype(np.int8)))
        spans, kept, gone, end = [], [], 0, 0
        for a, z in zip(at[edge[::2]].tolist(), at[edge[1::2]].tolist(), strict=True):
            spans.append((a, z))
            kept.append(raw[end:a])
            gone, end = gone + len(raw[a:z].split()), z
        if not spans:
            return t, total, 0, []
        places = [(len(raw[:a].decode()), len(raw[:z].decode())) for a, z in spans]
        return b"".join([*kept, raw[end:]]).decode(), total, gone, places

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [clean(*x) for x in zip(b.pop("__t"), b.pop("__later"), b.pop("__own"), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            out = b.copy()
            for name, c in zip((text, "n_words", "removed_words"), cols[:3], strict=True):
                out[name] = pd.Series(list(c), index=b.index, dtype=object)
            out["spans"] = pd.Series([[{"start": a, "stop": z} for a, z in s] for s in cols[3]], index=b.index, dtype=object)
            yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*rest).schema)
    return joined.mapInPandas(run, f"{kinds}, `{text}` string, n_words long, removed_words long, spans array<struct<start: long, stop: long>>")

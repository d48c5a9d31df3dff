"""Exact Jaccard self-join of documents on word n-grams with adaptive multi-match prefixes.

Documents of equal shingle sets are one class. All shingles are put into one order, rare ones first, by a count sketch of
fixed width that every document adds to. A document whose partners share at least t of its n shingles is known to share l
of its first n - t + l shingles with each of them; so each document picks the l that is cheapest for it by the counts of
its own prefix, and a pair is looked at only if it shares as many prefix shingles as the smaller of both choices asks for.

Pairs that pass are edges of a candidate graph. A shingle too common for pairs (by the sketch, or by its actual number of
documents) becomes a node of that graph instead and is joined to each of its documents, so candidates stay linear in the
input and no pair is lost. Each connected part of the graph is then verified with whole sets, in blocks of bounded size,
and gives the edges of a spanning forest and link counts, never all pairs.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize, small_batches
from .components import components
from .shingles import Shingler, mix, set_id

#: Counters of the sketch (16 MB), in segments that are summed apart.
WIDTH, SEGMENT = 1 << 22, 1 << 16
#: Choices of l, and the largest number of documents of a shingle whose pairs are listed.
MATCHES, PAIRED = (1, 2, 4, 8, 16), 64
#: Shingles in a block of whole sets (16 MB); two blocks meet in a task. Sets in a block, up to SPLIT blocks: a set is sent as often
#: as its part has blocks, so beyond SPLIT a part is cut by its shingles only.
BLOCK, SETS, SPLIT = 2_000_000, 256, 12


def _profile(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(id, n, sid) for each document and, where blob is set, (seg, blob): the partition's counts of a sketch segment."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, counts = Shingler(k), np.zeros(WIDTH, np.uint32)
        for b in batches:
            sets = [shingler.set_of(t) for t in b["t"]]
            if sets:
                at, n = np.unique(np.concatenate(sets) & np.uint64(WIDTH - 1), return_counts=True)
                counts[at.astype(np.int64)] += n.astype(np.uint32)
            yield pd.DataFrame({"id": b["id"], "n": [len(s) for s in sets], "sid": [set_id(s) for s in sets], "seg": -1, "blob": None}, dtype=object)
        for seg in range(WIDTH // SEGMENT):
            part = counts[seg * SEGMENT : (seg + 1) * SEGMENT]
            if part.any():
                yield pd.DataFrame({"id": [None], "n": [None], "sid": [None], "seg": [seg], "blob": [zlib.compress(part.astype("<u4").tobytes(), 1)]}, dtype=object)

    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInPandas(run, f"id {docs.schema[key].dataType.simpleString()}, n long, sid long, seg int, blob binary")


def _sketch(profile: DataFrame) -> np.ndarray:
    """The sum of all partitions' sketches: WIDTH counters, whatever the input."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for seg, blob in zip(b["seg"], b["blob"], strict=True):
                total[seg] = total.get(seg, 0) + np.frombuffer(zlib.decompress(blob), "<u4").astype(np.uint64)
        yield pd.DataFrame({"seg": list(total), "blob": [x.tobytes() for x in total.values()]}, dtype=object)

    out = np.zeros(WIDTH, np.uint64)
    parts = profile.filter("seg >= 0").select("seg", "blob").repartition("seg").mapInPandas(run, "seg int, blob binary")
    for row in parts.toLocalIterator():
        out[row["seg"] * SEGMENT : (row["seg"] + 1) * SEGMENT] = np.frombuffer(row["blob"], np.uint64)
    return out


def _postings(docs: DataFrame, k: int, percent: int, text: str, sketch: np.ndarray) -> DataFrame:
    """(deal, token, sid, info): the prefix shingles of each set once per partition; info packs n, the chosen l, the least l
    whose prefix has the token, and whether the sketch calls the token too common for pairs."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    load = float(sketch.mean())
    noise = load + 3 * math.sqrt(load)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, counts, seen = Shingler(k), shared.value, set()
        for b in batches:
            out = []
            for t in b["t"]:
                s = shingler.set_of(t)
                n = len(s)
                if not n or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                count = counts[(s & np.uint64(WIDTH - 1)).astype(np.int64)]
                need = -(-percent * n // 100)
                choices = [x for x in MATCHES if x <= need]
                most = n - need + choices[-1]
                order = np.lexsort((s, count))[:most]
                token, df = s[order], np.maximum(count[order].astype(float) - 1 - noise, 0)
                candidates = np.cumsum(df + 0.02)
                cost = [4 * (n - need + x) + candidates[n - need + x - 1] * (1 + n / 8 / x) for x in choices]
                pick = choices[int(np.argmin(cost))]
                token, df = token[: n - need + pick], df[: n - need + pick]
                level = np.maximum(1, np.arange(len(token)) - (n - need) + 1)
                common = df >= PAIRED
                info = (n << 17) | (pick << 9) | (level << 1) | common
                deal = np.where(common, np.uint64(sid & 0xFFFFFFFFFFFFFFFF), token)
                out.append((deal.view(np.int64), token.view(np.int64), np.full(len(token), sid, np.int64), info.astype(np.int64)))
            if out:
                deal, token, sids, info = map(np.concatenate, zip(*out, strict=True))
                yield pd.DataFrame({"deal": deal, "token": token, "sid": sids, "info": info})

    return docs.select(F.col(text).alias("t")).mapInPandas(run, "deal long, token long, sid long, info long")


def _pairs(token: np.ndarray, sid: np.ndarray, info: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, need) from whole runs of equal tokens, sorted by token and sid. need 0: b is a token, a node of its own."""
    first = np.ones(len(token), bool)
    first[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
    token, sid, info = token[first], sid[first], info[first]
    heads = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    sizes = np.diff(np.r_[heads, len(token)])
    size_of = np.repeat(sizes, sizes)
    node = ((info & 1) == 1) | (size_of > PAIRED)
    out = [(sid[node], token[node], np.zeros(int(node.sum()), np.int64))]
    open_ = ~node[heads]
    for m in np.unique(sizes[open_ & (sizes > 1)]):
        at = heads[open_ & (sizes == m)]
        i, j = np.triu_indices(m, 1)
        for part in np.array_split(at, max(1, len(at) * len(i) // 1_000_000)):
            x, y = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
            n, o = info[x] >> 17, info[y] >> 17
            need = np.minimum((info[x] >> 9) & 255, (info[y] >> 9) & 255)
            good = (100 * np.minimum(n, o) >= percent * np.maximum(n, o)) & (((info[x] >> 1) & 255) <= need) & (((info[y] >> 1) & 255) <= need)
            out.append((sid[x[good]], sid[y[good]], need[good]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of the candidate graph."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spilt = [np.zeros(0, np.int64)] * 3, None

        def rows(a: np.ndarray, b: np.ndarray, need: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (a, b, need)], ["a", "b", "need"])

        for batch in batches:
            token, sid, info = (np.r_[h, batch.column(c).to_numpy()] for h, c in zip(held, ("token", "sid", "info"), strict=True))
            if not len(token):
                continue
            if spilt is not None:
                same = token == spilt
                yield from rows(sid[same], token[same], np.zeros(int(same.sum()), np.int64))
                token, sid, info = token[~same], sid[~same], info[~same]
                if not len(token):
                    continue
                spilt = None
            last = int(np.searchsorted(token, token[-1]))
            yield from rows(*_pairs(token[:last], sid[:last], info[:last], percent)) if last else ()
            held = [token[last:], sid[last:], info[last:]]
            if len(held[0]) > 64 * PAIRED and len(np.unique(held[1])) > PAIRED:  # a run without end is not held
                spilt = token[-1]
                yield from rows(held[1], held[0], np.zeros(len(held[0]), np.int64))
                held = [np.zeros(0, np.int64)] * 3
        if len(held[0]):
            yield from rows(*_pairs(*held, percent))

    found = postings.repartition("deal").select("token", "sid", "info").sortWithinPartitions("token", "sid").mapInArrow(run, "a long, b long, need long")
    counted = found.groupBy("a", "b", "need").agg(F.count("*").alias("got"))
    return counted.filter("got >= need").select("a", "b")


def _verify(ids: list[int], sides: list[bool], sets: list[np.ndarray], weights: np.ndarray, percent: int, within: bool) -> list[tuple[int, int, int]]:
    """Spanning edges (a, b, 0) and link counts (a, a, links) of the pairs that hold: all pairs within a block, or those across two."""
    m = len(ids)
    n = np.array([len(s) for s in sets])
    label, linked, out = np.arange(m), np.zeros(m, np.int64), []
    side = np.array(sides)
    if m > 8:
        tokens = np.concatenate(sets)
        _, inverse, count = np.unique(tokens, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(m), n)
        lists = np.split(owner[np.argsort(inverse, kind="stable")], np.cumsum(count)[:-1])
        ends = np.r_[0, np.cumsum(n)]
    for i in range(m):
        if m > 8:
            mine = [lists[t] for t in inverse[ends[i] : ends[i + 1]]]
            both = np.bincount(np.concatenate(mine), minlength=m)
        else:
            both = np.array([len(np.intersect1d(sets[i], s, assume_unique=True)) if j > i else 0 for j, s in enumerate(sets)])
        hold = 100 * both >= percent * (n[i] + n - both)
        hold[: i + 1] = False
        if not within:
            hold &= side != side[i]
        js = np.flatnonzero(hold)
        if len(js):
            linked[i] += weights[js].sum()
            linked[js] += weights[i]
            for x in np.unique(label[js]):
                if x != label[i]:
                    out.append((ids[i], ids[js[label[js] == x][0]], 0))
                    label[label == x] = label[i]
    return out + [(ids[i], ids[i], int(linked[i])) for i in np.flatnonzero(linked)]


def _verified(docs: DataFrame, members: DataFrame, k: int, percent: int, key: str, text: str) -> DataFrame:
    """(a, b, links) over members (id, sid, copies, part, blocks): whole sets meet by part, in pairs of blocks."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(k)
        for b in batches:
            out = []
            for t, sid, copies, part, blocks in zip(b["t"], b["sid"], b["copies"], b["part"], b["blocks"], strict=True):
                s = shingler.set_of(t).tobytes()
                own = int(mix(np.array([sid], np.int64).view(np.uint64))[0] % np.uint64(blocks))
                out += [(part, min(own, x), max(own, x), x > own, sid, copies, s) for x in range(blocks)]
            yield pd.DataFrame(out, columns=["part", "i", "j", "side", "sid", "copies", "s"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, out = None, []

        def done() -> None:
            if len(held) > 1:
                out.extend(_verify([x[0] for x in held], [x[1] for x in held], [np.frombuffer(x[3], np.uint64) for x in held], np.array([x[2] for x in held]), percent, now[1] == now[2]))
            held.clear()

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("part", "i", "j", "sid", "side", "copies", "s")]
            for part, i, j, *rest in zip(*cols, strict=True):
                if (part, i, j) != now:
                    done()
                    now = (part, i, j)
                held.append(tuple(rest))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "links"])
                out.clear()
        done()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "links"])

    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(broadcast_if_small(members), "id")
    sets = texts.mapInPandas(spread, "part long, i int, j int, side boolean, sid long, copies long, s binary")
    return sets.repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(meet, "a long, b long, links long")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, n_links) per row of docs: documents link when 100 |A and B| >= percent |A or B|.

    component_id is the smallest key reachable by links; n_links counts the other documents linked directly, exact copies
    included. Null, empty and blank texts have no shingle and link with nothing, also not with each other. key: unique,
    of a type that can be compared; a row of a null key is kept and linked only through an exact copy that has a key. Other
    columns are not read.
    """
    small_batches(docs.sparkSession)
    profile = materialize(_profile(docs, k, key, text), "profile")
    each = profile.filter("seg < 0").select("id", "n", "sid")
    classes = materialize(each.filter("n > 0").groupBy("sid").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.count("*").alias("copies")), "classes")
    edges = materialize(_candidates(_postings(docs, k, percent, text, _sketch(profile)), percent), "candidates")
    parts = components(edges).join(classes, F.col("node") == F.col("sid")).select("id", "sid", "n", "copies", F.col("component").alias("part"))
    parts = materialize(parts, "parts")
    sizes = parts.groupBy("part").agg(F.count("*").alias("m"), F.sum("n").alias("total")).filter("m > 1")
    members = parts.join(sizes, "part").select("id", "sid", "copies", "part", F.greatest(F.ceil(F.col("total") / BLOCK), F.least(F.ceil(F.col("m") / SETS), F.lit(SPLIT))).cast("int").alias("blocks"))
    links = materialize(_verified(docs, materialize(members, "members"), k, percent, key, text), "links")
    counts = links.groupBy(F.col("a").alias("sid")).agg(F.sum("links").alias("links"))
    group = classes.join(components(links).withColumnRenamed("node", "sid"), "sid", "left").join(counts, "sid", "left")
    group = group.select("sid", "id", "copies", F.coalesce("component", "sid").alias("g"), F.coalesce("links", F.lit(0)).alias("links"))
    least = group.groupBy("g").agg(F.min("id").alias("least"))
    named = materialize(group.join(least, "g").select("sid", "least", (F.col("links") + F.col("copies") - 1).alias("links")), "named")
    out = each.join(named, "sid", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))

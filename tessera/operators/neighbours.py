"""Exact nearest neighbours by cosine distance over cells of a metric space, with triangle-inequality bounds.

Unit vectors lie in the cell of their nearest pivot and keep their distance to it. A query first looks into the cells around
it that hold k vectors; the k-th of these bounds what it still has to see. A cell is left out if it lies farther than that
from the query by its inner and outer radius, or by the plane between its pivot and the query's nearest; in the others, a
vector is left out by its own distance to the pivot. Queries are joined to cells on the cluster, in groups of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import written

#: Most pivots, queries that a task holds at once, and vectors of a cell that go to one task.
MOST_PIVOTS, HELD_QUERIES, CELL_ROWS = 256, 2_000, 50_000
#: Distances are rounded and ties broken later, so what is this close to the k-th is passed on.
SLACK = 1e-5


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, which rows they are): those of `width` finite numbers that are not all 0."""
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.flatnonzero((sizes == width) & ~np.asarray(column.is_null()))
    flat = column.take(pa.array(rows)).flatten()
    m = flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), width)
    with np.errstate(invalid="ignore", over="ignore"):
        size = np.linalg.norm(m, axis=1)
    good = np.isfinite(size) & (size > 0)
    return m[good] / size[good, None], rows[good]


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors in space; a metric, unlike the cosine distance, which is half its square."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


@dataclass
class Cells:
    """Written vectors (cell, slot, r, key, v) by cell; pivots and, of each cell, its number of vectors and its radii."""

    table: DataFrame
    pivots: np.ndarray
    count: np.ndarray
    inner: np.ndarray
    outer: np.ndarray


def build_cells(vectors: DataFrame, width: int, key: str, vector: str, pivots: int | None = None) -> Cells:
    """Cells of the vectors that have `width` finite numbers and are not 0; the others have no distance to anything.

    Pivots are vectors of the table, those of the smallest hashes: at most MOST_PIVOTS, about the square root of their number
    unless it is given.
    """
    source = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).filter(F.size("v") == width)
    n = pivots or max(1, min(MOST_PIVOTS, math.isqrt(source.count())))
    drawn = source.orderBy(F.xxhash64("key", "v")).limit(n).select("v").toArrow()
    chosen = _matrix(drawn.column(0).combine_chunks(), width)[0] if drawn.num_rows else np.zeros((0, width))
    if not len(chosen):
        chosen = np.eye(1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for b in batches:
            m, rows = _matrix(b.column(1), width)
            d = _chords(m, chosen)
            cell = d.argmin(axis=1) if len(d) else np.zeros(0, int)
            ends = pa.array(np.arange(len(m) + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(cell.astype(np.int32)), pa.array(np.arange(at, at + len(m))), pa.array(d[np.arange(len(m)), cell]), b.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array(m.ravel())),
            ], ["cell", "slot", "r", "key", "v"])
            at += len(m)

    kind = source.schema["key"].dataType.simpleString()
    table = written(source.mapInArrow(run, f"cell int, slot long, r double, key {kind}, v array<double>"), "cells")
    count, inner, outer = np.zeros(len(chosen), np.int64), np.full(len(chosen), np.inf), np.full(len(chosen), -np.inf)
    for r in table.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("a"), F.max("r").alias("z")).collect():
        count[r.cell], inner[r.cell], outer[r.cell] = r.n, r.a, r.z
    return Cells(table, chosen, count, inner, outer)


def _visits(asked: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(id, cell, seed, least): the cells that hold vectors, with a lower bound of their distance to each query; seeds are the
    nearest that together hold k vectors."""

    pivots, count, inner, outer = cells.pivots, cells.count, cells.inner, cells.outer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.flatnonzero(count)
        for b in batches:
            m = np.stack(b.column(1).to_numpy(zero_copy_only=False)) if b.num_rows else np.zeros((0, pivots.shape[1]))
            d = _chords(m, pivots)
            for i, row in zip(b.column(0).to_pylist(), d, strict=True):
                order = full[np.argsort(row[full], kind="stable")]
                seed = np.cumsum(count[order]) - count[order] < k
                least = np.maximum.reduce([row[order] - outer[order], inner[order] - row[order], (row[order] - row.min()) / 2, np.zeros(len(order))])
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(order), pa.int64()), pa.array(order.astype(np.int32)), pa.array(seed), pa.array(least)], ["id", "cell", "seed", "least"])

    return asked.select("id", "v").mapInArrow(run, "id long, cell int, seed boolean, least double")


def _look(cells: Cells, visits: DataFrame, asked: DataFrame, k: int, measure: bool) -> DataFrame:
    """(id, key, distance) of about the k nearest vectors of every visited cell; visits: (id, cell, limit), limit a distance in
    space. measure: (looked) instead, the pairs whose distance was taken."""
    groups = max(1, math.ceil(asked.count() / HELD_QUERIES))
    group = F.pmod(F.col("id"), F.lit(groups)).cast("int").alias("part")
    # a large cell is dealt to several tasks
    deals = F.create_map(*[x for c, n in enumerate(cells.count.tolist()) if n for x in (F.lit(c), F.lit(-(-n // CELL_ROWS)))]) if cells.count.any() else F.create_map(F.lit(0), F.lit(1))
    places = F.explode(F.sequence(F.lit(0), deals[F.col("cell")] - 1)).alias("deal")
    going = visits.join(asked.select("id", "v"), "id").select("cell", group, places, F.lit(0).alias("kind"), "id", F.col("limit").alias("x"), "v")
    wanted = going.select("cell", "part").distinct()
    held = cells.table.select("cell", F.pmod(F.col("slot"), deals[F.col("cell")].cast("long")).cast("int").alias("deal"), F.col("r").alias("x"), "key", "v").join(wanted, "cell")
    rows = going.withColumn("key", F.lit(None).cast(cells.table.schema["key"].dataType)).unionByName(held.select("cell", "part", "deal", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), "x", "v", "key"))
    met = rows.select("cell", "part", "deal", "kind", "id", "x", "key", "v").repartition("cell", "part", "deal").sortWithinPartitions("cell", "part", "deal", "kind")

    pivots = cells.pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, looked = None, 0
        ids, limits, unit = [], [], []
        q = far = limit = number = None
        for b in batches:
            cell, part, deal, kind = (b.column(i).to_numpy() for i in range(4))
            x, v = b.column(5).to_numpy(), b.column(7)
            m = v.flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            change = np.flatnonzero(np.r_[True, (np.diff(cell) != 0) | (np.diff(part) != 0) | (np.diff(deal) != 0) | (np.diff(kind) != 0)]) if b.num_rows else []
            for a, z in zip(change, [*change[1:], b.num_rows], strict=True):
                this = (cell[a], part[a], deal[a])
                if this != now:
                    now, q = this, None
                    ids, limits, unit = [], [], []
                if kind[a] == 0:
                    ids.append(b.column(4).slice(a, z - a).to_numpy())
                    limits.append(x[a:z])
                    unit.append(m[a:z])
                    q = None
                    continue
                if q is None:
                    q, limit, number = np.concatenate(unit), np.concatenate(limits), np.concatenate(ids)
                    far = _chords(q, pivots[now[0] : now[0] + 1])[:, 0]
                for at in range(a, z, 1024):
                    end = min(at + 1024, z)
                    near = np.abs(far[None, :] - x[at:end, None]) <= limit[None, :]
                    looked += int(near.sum())
                    some = np.flatnonzero(near.any(axis=1))
                    if measure or not len(some):
                        continue
                    distance = 1.0 - m[at:end][some] @ q.T
                    distance[~near[some]] = np.inf
                    most = np.partition(distance, k - 1, axis=0)[k - 1] + SLACK if len(some) > k else np.full(len(q), np.inf)
                    i, row = np.nonzero((np.isfinite(distance) & (distance <= most)).T)
                    yield pa.RecordBatch.from_arrays([pa.array(number[i]), b.column(6).take(pa.array(at + some[row])), pa.array(distance[row, i])], ["id", "key", "distance"])
        if measure:
            yield pa.RecordBatch.from_arrays([pa.array([looked], pa.int64())], ["looked"])

    kind = cells.table.schema["key"].dataType.simpleString()
    return met.mapInArrow(run, "looked long" if measure else f"id long, key {kind}, distance double")


def _space(distance: Column) -> Column:
    """Distance in space that a cosine distance and the slack stand for."""
    return F.sqrt(2 * (distance + F.lit(SLACK))) + F.lit(1e-7)


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query: str = "query_id", vector: str = "embedding", digits: int = 6, max_distance: float | None = None, cells: Cells | None = None, measure: bool = False) -> DataFrame:
    """(query, key, distance, rank): exact cosine distance of a stated set of queries to their k nearest vectors, larger key first
    on ties.

    Vectors and queries that are null, 0, not finite or of another size than the queries have no distance. cells: those of
    vectors, built before. measure: one row (pairs, looked) instead, all pairs and those whose distance was taken.
    """
    width = queries.select(F.max(F.size(vector))).first()[0]
    width = width if width and width > 0 else 1
    cells = cells or build_cells(vectors, width, key, vector)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, rows = _matrix(b.column(1), width)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * width, pa.int32()), pa.array(m.ravel()))], ["q", "v"])

    kind = queries.schema[query].dataType.simpleString()
    given = queries.select(F.col(query).alias("q"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null")
    asked = written(given.mapInArrow(units, f"q {kind}, v array<double>").withColumn("id", F.monotonically_increasing_id()), "queries")
    visits = written(_visits(asked, cells, k), "visits")
    top = F.lit(float("inf")) if max_distance is None else _space(F.lit(float(max_distance)))
    first = written(_look(cells, visits.filter("seed").withColumn("limit", top), asked, k, False), "seeds")
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance"))
    known = first.withColumn("place", place).filter(F.col("place") == k).select("id", _space(F.greatest("distance", F.lit(0.0))).alias("kth"))
    rest = visits.filter("not seed").join(known, "id", "left").withColumn("limit", F.least(top, F.coalesce("kth", F.lit(float("inf"))))).filter(F.col("least") <= F.col("limit"))
    if measure:
        looked = _look(cells, visits.filter("seed").withColumn("limit", top), asked, k, True).unionByName(_look(cells, rest, asked, k, True))
        return looked.agg(F.sum("looked").alias("looked")).select(F.lit(int(cells.count.sum()) * asked.count()).cast("long").alias("pairs"), "looked")
    found = first.unionByName(_look(cells, rest, asked, k, False)).withColumn("distance", F.round("distance", digits) + 0.0)
    if max_distance is not None:
        found = found.filter(F.col("distance") <= max_distance)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.asc("distance"), F.desc("key")))).filter(F.col("rank") <= k)
    return best.join(asked.select("id", "q"), "id").select(F.col("q").alias(query), F.col("key").alias(key), "distance", "rank")

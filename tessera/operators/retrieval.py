"""Hybrid retrieval over many queries at once: postings, BM25, phrases, cover density, exact vectors, fusion, diversity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tessera.functions.text import BM25_TOKEN, tokens


def postings(docs: DataFrame, key: str, text: str, pattern: str = BM25_TOKEN) -> DataFrame:
    """(key, term, pos) of every token; the searchable form of a corpus."""
    return docs.select(key, F.posexplode(tokens(F.col(text), pattern)).alias("pos", "term"))


#: Asked terms up to which they are sent to the postings; beyond, both are shuffled by term.
SENT_TERMS = 100_000


def asked_postings(asked: DataFrame, post: DataFrame) -> DataFrame:
    """asked joined to the postings of its terms. Asked terms of a counted size go to the postings, so that a common term's postings
    stay where their documents are instead of meeting in one task."""
    return post.join(F.broadcast(asked) if asked.count() <= SENT_TERMS else asked, "term")


def top_k(scored: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def any_term(post: DataFrame, asked: DataFrame, key: str, query: str) -> DataFrame:
    """(query, key) where a document has at least one of the query's terms."""
    return asked_postings(asked.select(query, "term").distinct(), post).select(query, key).distinct()


def phrase(post: DataFrame, asked: DataFrame, key: str, query: str) -> DataFrame:
    """(query, key) where the query's terms stand next to each other in order: shifted positions of all terms agree.

    asked: (query, i, term) with i from 0.
    """
    size = asked.groupBy(query).agg(F.count("*").alias("n"))
    shifted = asked_postings(asked, post).select(query, key, (F.col("pos") - F.col("i")).alias("start"))
    return shifted.groupBy(query, key, "start").agg(F.count("*").alias("got")).join(size, query).filter("got = n").select(query, key).distinct()


def cover_density(lists: Column) -> Column:
    """Cover density of a document: for each minimal span with all terms, its weights' share of its length; r / (r + 1).

    lists: array, by term, of the term's (pos, w). A span's score is the harmonic mean of its weights over the words that are not
    terms; a weight of 0 counts as 0.1. A term without a place gives 0. One fold over all places in order: the last place of each
    term is held, and a span ends where the earliest of these moves on.
    """
    places = F.array_sort(F.flatten(F.transform(lists, lambda l, t: F.transform(l, lambda x: F.struct(x["pos"].cast("long").alias("pos"), t.alias("t"), x["w"].cast("double").alias("w"))))))
    place = "struct<i:long,pos:long,before:double>"
    unseen = F.struct(F.lit(-1).cast("long").alias("i"), F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("before")).cast(place)
    start = F.struct(F.transform(lists, lambda _: unseen).alias("last"), F.lit(-1).cast("long").alias("i"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("first"), F.lit(0.0).alias("total"))

    def seen(state: Column, x: Column) -> Column:
        i = state["i"] + 1
        here = F.struct(i.alias("i"), x["pos"].alias("pos"), state["sum"].alias("before")).cast(place)
        return F.struct(F.transform(state["last"], lambda l, t: F.when(t == x["t"], here).otherwise(l)).alias("last"), i.alias("i"), (state["sum"] + F.when(x["w"] > 0, 1 / x["w"]).otherwise(10.0)).alias("sum"), state["first"].alias("first"), state["total"].alias("total"))

    def covered(now: Column, x: Column) -> Column:
        low = F.array_min(now["last"])
        length = now["i"] - low["i"] + 1
        noise = F.greatest(F.lit(0), x["pos"] - low["pos"] - (length - 1))
        score = length / (now["sum"] - low["before"]) / (1 + noise)
        new = low["i"] > now["first"]
        return F.struct(now["last"].alias("last"), now["i"].alias("i"), now["sum"].alias("sum"), F.when(new, low["i"]).otherwise(now["first"]).alias("first"), (now["total"] + F.when(new, score).otherwise(0.0)).alias("total"))

    # the state with the place is taken up once and looked at twice
    step = lambda state, x: F.element_at(F.transform(F.array(seen(state, x)), lambda now: covered(now, x)), 1)
    return F.aggregate(places, start, step, lambda state: state["total"] / (state["total"] + 1))


#: Weights by the field's meaning; the compatible set gives them by the inverted labels that an array order implies.
FIELD_WEIGHTS = {"high": 1.0, "medium": 0.45, "low": 0.18}
COMPATIBLE_WEIGHTS = {"high": 0.0, "medium": 0.18, "low": 0.45}


def rank_cover_density(post: DataFrame, asked: DataFrame, key: str, query: str, weights: dict[str, float] | None = None) -> DataFrame:
    """(query, key, score) for documents with all terms of a query. post: (key, term, pos, field) with fields high, medium, low."""
    named = weights or FIELD_WEIGHTS
    weight = F.coalesce(F.create_map(*[x for k, v in named.items() for x in (F.lit(k), F.lit(v))])[F.col("field")], F.lit(0.0))
    size = asked.select(query, "term").distinct().groupBy(query).agg(F.count("*").alias("n"))
    lists = asked_postings(asked.select(query, "term").distinct(), post.withColumn("w", weight)).groupBy(query, key, "term").agg(F.sort_array(F.collect_list(F.struct("pos", "w"))).alias("l"))
    whole = lists.groupBy(query, key).agg(F.sort_array(F.collect_list(F.struct("term", "l"))).alias("ls"), F.count("*").alias("got")).join(size, query).filter("got = n")
    return whole.select(query, key, cover_density(F.transform("ls", lambda t: t["l"])).alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def valid_vector(vector: Column, dimension: int) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dimension) & ~bad, F.lit(False))


def fuse(branches: list[tuple[DataFrame, float]], query: str, key: str, k: int = 60, digits: int = 9, smaller_first: bool = False) -> DataFrame:
    """(query, key, score, rank): weighted reciprocal ranks. Branches are (query, key, rank); repeats count by their best rank
    and ranks close up after them; a branch of weight 0 or less is left out; equal scores go to the larger key, or to the
    smaller."""
    used = [(b, w) for b, w in branches if w > 0]
    parts = []
    for b, w in used:
        best = b.groupBy(query, key).agg(F.min("rank").alias("r"))
        again = best.withColumn("r", F.row_number().over(Window.partitionBy(query).orderBy("r", key)))
        parts.append(again.select(query, key, (F.lit(float(w)) / (k + F.col("r"))).alias("s")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    scored = whole.groupBy(query, key).agg(F.round(F.sum("s"), digits).alias("score"))
    tie = F.asc(key) if smaller_first else F.desc(key)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), tie)))


def guarded(semantic: DataFrame, lexical: DataFrame, query: str, max_distance: float) -> DataFrame:
    """Semantic hits; where a query has no lexical hit at all, only those within max_distance."""
    counts = lexical.groupBy(query).agg(F.count("*").alias("__n"))
    return semantic.join(counts, query, "left").filter(F.col("__n").isNotNull() | (F.col("distance") <= max_distance)).drop("__n")


def rerank(fused: DataFrame, scores: DataFrame, query: str, key: str, head: int) -> DataFrame:
    """The first `head` results by their new score (larger key first on ties), then the rest as they were."""
    joined = fused.join(scores.select(query, key, F.col("score").alias("__new")), [query, key], "left")
    is_tail = F.col("rank") > head
    order = Window.partitionBy(query).orderBy(is_tail, F.when(~is_tail, F.coalesce("__new", F.lit(0.0))).desc_nulls_last(), F.when(is_tail, F.col("rank")), F.desc(key))
    return joined.withColumn("rank", F.row_number().over(order)).drop("__new")


def diversify(ranked: DataFrame, query: str, origin: str, limit: int) -> DataFrame:
    """Results beyond `limit` of one origin move behind all others; none is dropped. A result of a null origin is its own origin."""
    if limit <= 0:
        return ranked
    own = F.coalesce(F.concat(F.lit("o"), F.col(origin).cast("string")), F.concat(F.lit("r"), F.col("rank").cast("string")))
    place = F.row_number().over(Window.partitionBy(query, own).orderBy("rank"))
    late = ranked.withColumn("__late", place > limit)
    return late.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("__late", "rank"))).drop("__late")


def embed_with(rows: DataFrame, text: str, provider: Callable[[list[str]], list[list[float]]], dimension: int, out: str = "embedding") -> DataFrame:
    """rows with vectors of a provider, asked in Arrow batches where the rows are; null texts are asked as empty ones. Vectors that are not
    `dimension` finite numbers are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = provider(["" if t is None else t for t in b[text]])
            good = [list(map(float, v)) if len(v) == dimension and np.isfinite(np.asarray(v, float)).all() else None for v in got]
            yield b.assign(**{out: pd.Series(good, index=b.index, dtype=object)})

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(out, ArrayType(DoubleType()))]))


def rerank_with(pairs: DataFrame, query: str, document: str, provider: Callable[[list[tuple[str, str]]], list[float]], out: str = "score") -> DataFrame:
    """pairs of texts with a provider's scores, asked in Arrow batches where the pairs are; null texts are asked as empty ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = lambda c: ["" if t is None else t for t in b[c]]  # noqa: B023, E731
            yield b.assign(**{out: pd.Series(provider(list(zip(text(query), text(document), strict=True))), index=b.index, dtype=float)})

    return pairs.mapInPandas(run, StructType([*pairs.schema.fields, StructField(out, DoubleType())]))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def thresholded(ranked: DataFrame, scores: DataFrame, query: str, key: str, head: int, least: float) -> DataFrame:
    """Results of at least `least`, reranked; head results that fall below it by their new score go as well, and ranks close up."""
    kept = ranked.filter(F.col("score") >= least)
    ordered = rerank(kept, scores, query, key, head).join(scores.select(query, key, F.col("score").alias("__new")), [query, key], "left")
    new = F.when(F.col("__new").isNotNull(), F.col("__new")).otherwise(F.col("score"))
    passed = ordered.withColumn("score", new).filter(F.col("score") >= least).drop("__new")
    return passed.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("rank")))


def effective_mode(wanted: str, lexical_ok: bool, semantic_ok: bool) -> str:
    """What is left of a mode when a branch is down; none where nothing is."""
    if wanted == "hybrid":
        return "hybrid" if lexical_ok and semantic_ok else "lexical" if lexical_ok else "semantic" if semantic_ok else "none"
    if wanted == "semantic":
        return "semantic" if semantic_ok else "lexical" if lexical_ok else "none"
    return "lexical" if lexical_ok else "none"


def effective_modes(wanted: Column, lexical_ok: Column, semantic_ok: Column) -> Column:
    """effective_mode() of columns; any other mode than hybrid and semantic is lexical."""
    states = [(a, b) for a in (True, False) for b in (True, False)]
    by_state = lambda mode: F.coalesce(*[F.when((lexical_ok == a) & (semantic_ok == b), effective_mode(mode, a, b)) for a, b in states])
    return F.when(wanted == "hybrid", by_state("hybrid")).when(wanted == "semantic", by_state("semantic")).otherwise(by_state("lexical"))


def degraded(branch_states: dict[str, Column]) -> Column:
    """Names and states of the branches that did not answer (timeout, error, unavailable), as a map in the given order."""
    failed = F.array_compact(F.array(*[F.when(c.isin("timeout", "error", "unavailable"), F.struct(F.lit(n).alias("key"), c.alias("value"))) for n, c in branch_states.items()]))
    return F.map_from_entries(failed)


def partial_results(shown: Column, matched: Column, offset: Column, vanished: Column, degraded_branches: Column) -> Column:
    """Whether a page is only a part: more pages follow, rows vanished between the ranking and the read, or a branch was down."""
    return (offset + shown + vanished < matched) | (vanished > 0) | degraded_branches

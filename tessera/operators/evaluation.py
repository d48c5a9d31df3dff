"""Graded retrieval evaluation: metrics in both null conventions, agreement, association, significance, sampling, checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import seeded

RELEVANT = 2


def _gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def query_metrics(run: DataFrame, qrels: DataFrame, queries: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10), undefined_as_one: bool = False, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """One row per query and cutoff. run: (query, key, rank from 1); qrels: (query, key, grade); queries: all queries.

    A pair without a judgment is unjudged: it earns nothing and is counted apart from grade 0. Where a metric is undefined (no
    relevant document, no ideal gain) it is null, or 1 with undefined_as_one. Repeated keys of a run count once, by best rank,
    and ranks close up.
    """
    clean = run.groupBy(query, key).agg(F.min("rank").alias("rank"))
    clean = clean.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("rank", key)))
    judged = clean.join(qrels, [query, key], "left")
    ideal = qrels.withColumn("i", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade"), key)))
    per = [F.count_if(F.col("grade") >= RELEVANT).alias("relevant"), F.count("*").alias("judged_total")]
    per += [F.sum(F.when(F.col("i") <= k, _gain(F.col("grade")) / F.log2(F.col("i") + 1.0))).alias(f"ideal_{k}") for k in cutoffs]
    truth = ideal.groupBy(query).agg(*per)
    above = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    walked = judged.withColumn("bad_above", F.coalesce(F.sum((F.col("grade") < RELEVANT).cast("int")).over(above), F.lit(0)))
    hit = F.col("grade") >= RELEVANT
    agg = [F.count("*").alias("returned"), F.min(F.when(hit, F.col("rank"))).alias("first")]
    for k in cutoffs:
        top = F.col("rank") <= k
        agg += [
            F.count_if(top & hit).alias(f"hits_{k}"),
            F.sum(F.when(top, F.coalesce(_gain(F.col("grade")), F.lit(0.0)) / F.log2(F.col("rank") + 1.0))).alias(f"dcg_{k}"),
            F.count_if(top & F.col("grade").isNull()).alias(f"unjudged_{k}"),
            F.count_if(top & (F.col("grade") == 0)).alias(f"zero_{k}"),
        ]
    seen = walked.groupBy(query).agg(*agg)
    least = F.least("relevant", F.col("judged_total") - F.col("relevant"))
    credit = F.when(least == 0, F.lit(1.0)).otherwise(1 - F.least("bad_above", "relevant") / least)
    bpref = walked.filter(hit).join(truth.select(query, "relevant", "judged_total"), query).groupBy(query).agg((F.sum(credit) / F.first("relevant")).alias("bpref"))
    joined = queries.select(query).distinct().join(truth, query, "left").join(seen, query, "left").join(bpref, query, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    undefined = F.lit(1.0) if undefined_as_one else F.lit(None).cast("double")
    relevant = zero("relevant")
    cut = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[(zero(f"{n}_{k}")).alias(n) for n in ("hits", "unjudged", "zero")], F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)).alias("dcg"), F.coalesce(F.col(f"ideal_{k}"), F.lit(0.0)).alias("ideal")) for k in cutoffs])).alias("c")
    rows = joined.select(query, "judged_total", relevant.alias("relevant"), zero("returned").alias("returned"), "first", "bpref", cut)
    depth = F.least("c.k", "returned")
    return rows.select(
        query,
        F.col("c.k").alias("k"),
        "returned",
        "relevant",
        F.when(F.col("relevant") == 0, undefined).otherwise(F.col("c.hits") / F.col("relevant")).alias("recall"),
        (F.col("c.hits") / F.col("c.k")).alias("precision"),
        F.when(F.col("c.ideal") == 0, undefined).otherwise(F.col("c.dcg") / F.col("c.ideal")).alias("ndcg"),
        F.when(depth == 0, F.lit(None)).otherwise((depth - F.col("c.unjudged")) / depth).alias("judged"),
        F.col("c.unjudged").alias("unjudged"),
        F.col("c.zero").alias("explicit_zero"),
        F.when(F.col("first").isNotNull(), 1 / F.col("first")).otherwise(F.lit(0.0) if undefined_as_one else F.when(F.col("relevant") > 0, F.lit(0.0))).alias("mrr"),
        F.when(F.col("relevant") > 0, F.coalesce("bpref", F.lit(0.0))).alias("bpref"),
    )


def macro(metrics: DataFrame, by: list[str], names: tuple[str, ...] = ("recall", "precision", "ndcg", "mrr", "bpref"), digits: int = 6) -> DataFrame:
    """Means over the queries where a metric is defined, with their number as support."""
    columns = [c for n in names for c in (F.round(F.avg(n), digits).alias(n), F.count(n).alias(f"{n}_support"))]
    return metrics.groupBy(*by).agg(*columns)


def micro_unjudged(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Unjudged results over all results shown; null where nothing was shown."""
    shown = F.sum(F.least("k", "returned"))
    return metrics.groupBy(*by).agg(F.when(shown > 0, F.sum("unjudged") / shown).alias("unjudged_rate"))


def nearest_rank(rows: DataFrame, value: str, fractions: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    return rows.agg(*[F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{round(100 * p)}") for p in fractions])


def pool(systems: dict[str, DataFrame], depth: int, query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, key, contributions, best_rank): union of the systems' first `depth` results."""
    whole = None
    for name, run in systems.items():
        part = run.filter(F.col("rank") <= depth).select(query, key, F.lit(name).alias("system"), F.col("rank").cast("int").alias("rank"))
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy(query, key).agg(F.sort_array(F.collect_list(F.struct("system", "rank"))).alias("contributions"), F.min("rank").alias("best_rank"))


def confusion(pairs: DataFrame, grades: int = 4) -> DataFrame:
    """(a, b, n) over the whole grid of grades, with zeros."""
    spark = pairs.sparkSession
    grid = spark.range(grades * grades).select((F.col("id") / grades).cast("int").alias("a"), (F.col("id") % grades).cast("int").alias("b"))
    counts = pairs.groupBy(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")).agg(F.count("*").alias("n"))
    return grid.join(counts, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def weighted_kappa(pairs: DataFrame, grades: int = 4, quadratic: bool = True, degenerate: float | None = None) -> DataFrame:
    """(n, observed, expected, kappa); kappa is `degenerate` (null) where no disagreement is expected."""
    cells = confusion(pairs, grades)
    rows, columns = Window.partitionBy("a"), Window.partitionBy("b")
    weight = F.abs(F.col("a") - F.col("b")) / (grades - 1)
    weight = weight * weight if quadratic else weight
    placed = cells.withColumns({"ra": F.sum("n").over(rows), "cb": F.sum("n").over(columns), "w": weight})
    sums = placed.agg(F.sum("n").alias("n"), F.sum(F.col("w") * F.col("n")).alias("o"), F.sum(F.col("w") * F.col("ra") * F.col("cb")).alias("e"))
    known = sums.select("n", (F.col("o") / F.col("n")).alias("observed"), (F.col("e") / (F.col("n") * F.col("n"))).alias("expected"))
    return known.withColumn("kappa", F.when(F.col("expected") > 0, 1 - F.col("observed") / F.col("expected")).otherwise(F.lit(degenerate).cast("double")))


def cramers_v(rows: DataFrame, a: str, b: str) -> DataFrame:
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    margins = cells.withColumns({"ra": F.sum("o").over(Window.partitionBy("a")), "cb": F.sum("o").over(Window.partitionBy("b"))})
    n = cells.agg(F.sum("o").alias("n"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    # cells that do not occur add their expectation, so chi square is n (sum o^2 / (ra cb) - 1)
    chi = margins.agg(F.sum(F.col("o") * F.col("o") / (F.col("ra") * F.col("cb"))).alias("s")).crossJoin(n)
    least = F.least("r", "c") - 1
    return chi.select(F.when(least > 0, F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / least)).alias("v"), "n")


def share_drift(p: DataFrame, q: DataFrame, key: str) -> DataFrame:
    """Largest difference of a key's share between two tables."""
    shares = [d.groupBy(key).agg(F.count("*").alias("n")).withColumn(f"s{i}", F.col("n") / F.sum("n").over(Window.partitionBy())).drop("n") for i, d in enumerate((p, q))]
    both = shares[0].join(shares[1], key, "full_outer")
    return both.agg(F.max(F.abs(F.coalesce("s0", F.lit(0.0)) - F.coalesce("s1", F.lit(0.0)))).alias("drift"))


#: Differences up to which every sign pattern is tried; beyond, patterns are drawn.
EXACT = 20


def exact_permutation(differences: DataFrame, value: str = "d") -> DataFrame:
    """(n, observed, p): two-sided sign permutation over all 2^n patterns, for at most EXACT differences; p is null beyond, and 1
    without any. Patterns are dealt over the cluster."""
    listed = differences.agg(F.collect_list(F.col(value).cast("double")).alias("ds")).withColumn("n", F.size("ds"))
    few = listed.filter(F.col("n") <= EXACT)
    masks = few.select("ds", "n", F.explode(F.sequence(F.lit(0), F.expr("shiftleft(1, n) - 1"))).alias("mask"))
    signed = F.aggregate(F.transform("ds", lambda d, i: F.when(F.col("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) == 0, d).otherwise(-d)), F.lit(0.0), lambda s, x: s + x)
    total = F.abs(F.aggregate("ds", F.lit(0.0), lambda s, x: s + x))
    p = masks.agg(F.avg((F.abs(signed) >= total - 1e-12).cast("double")).alias("p"))
    return listed.crossJoin(p).select("n", F.when(F.col("n") > 0, total / F.col("n")).otherwise(0.0).alias("observed"), F.when(F.col("n") == 0, 1.0).otherwise(F.col("p")).alias("p"))


def exact_sign_test(d: np.ndarray) -> float:
    """The same for one short vector."""
    sums = np.zeros(1)
    for x in d:
        sums = np.r_[sums + x, sums - x]
    return float(np.mean(np.abs(sums) / len(d) >= abs(d.sum() / len(d)) - 1e-12))


def mulberry32(seed: int, n: int, skip: int = 0) -> np.ndarray:
    """Numbers skip to skip + n in [0, 1) of a 32-bit generator that other engines share; each needs the count of steps only."""
    mask = np.uint64(0xFFFFFFFF)
    first = (seed + 0x6D2B79F5 * skip) & 0xFFFFFFFF
    state = (np.uint64(first) + np.uint64(0x6D2B79F5) * np.arange(1, n + 1, dtype=np.uint64)) & mask
    t = ((state ^ (state >> np.uint64(15))) * (state | np.uint64(1))) & mask
    more = ((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & mask
    t = t ^ ((t + more) & mask)
    return ((t ^ (t >> np.uint64(14))) & mask) / 4294967296.0


#: Seeds of a permutation test alone, and of intervals and whole comparisons.
PERMUTATION_SEED, COMPARISON_SEED = 0x5EED, 0xB007


def monte_carlo_permutation(d: np.ndarray, iterations: int = 100_000, seed: int = PERMUTATION_SEED) -> float:
    """Two-sided p of a sign permutation by resampling: (extreme + 1) / (iterations + 1). No and all-zero differences give 1."""
    d = np.asarray(d, float)
    if not len(d) or not d.any():
        return 1.0
    observed, extreme, block = abs(d.mean()), 0, max(1, 2_000_000 // len(d))
    done = 0
    while done < iterations:
        m = min(block, iterations - done)
        u = mulberry32(seed, m * len(d), done * len(d)).reshape(m, len(d))
        extreme += int((np.abs(np.where(u < 0.5, d, -d).mean(axis=1)) >= observed - 1e-12).sum())
        done += m
    return (extreme + 1) / (iterations + 1)


def permutation_p(d: np.ndarray, iterations: int = 100_000, seed: int = PERMUTATION_SEED) -> float:
    """Exact up to EXACT differences, by resampling beyond."""
    d = np.asarray(d, float)
    return exact_sign_test(d) if 0 < len(d) <= EXACT and d.any() else monte_carlo_permutation(d, iterations, seed)


#: Factor and addend of the congruential generator of release reports.
LCG = (1664525, 1013904223)


def lcg_steps(n: int) -> tuple[int, int]:
    """(factor, addend) of n steps of the generator at once, by halving."""
    factor, addend, a, c = 1, 0, *LCG
    while n:
        if n & 1:
            factor, addend = factor * a & 0xFFFFFFFF, (addend * a + c) & 0xFFFFFFFF
        a, c, n = a * a & 0xFFFFFFFF, (a + 1) * c & 0xFFFFFFFF, n >> 1
    return factor, addend


def lcg(seed: int, n: int, skip: int = 0) -> np.ndarray:
    """Numbers skip to skip + n in [0, 1) of the generator of release reports: it jumps to the first, and powers of its factor, which
    wrap as its states do, give the others at once."""
    factor, addend = lcg_steps(skip)
    start = np.uint64((seed * factor + addend) & 0xFFFFFFFF)
    powers = np.cumprod(np.full(n, LCG[0], np.uint64))
    sums = np.cumsum(np.concatenate([[np.uint64(1)], powers[:-1]])) if n else powers
    return ((powers * start + np.uint64(LCG[1]) * sums) & np.uint64(0xFFFFFFFF)) / 4294967296.0


def bootstrap_interval(d: np.ndarray, iterations: int = 10_000, seed: int = COMPARISON_SEED, level: float = 0.95, generator=mulberry32) -> dict[str, float]:
    """Percentile interval of the mean, with bias and standard error of the resampled means; NaN bounds for no values."""
    d = np.asarray(d, float)
    if not len(d):
        return {"low": math.nan, "high": math.nan, "bias": 0.0, "se": 0.0}
    picks = (generator(seed, iterations * len(d)) * len(d)).astype(int).reshape(iterations, len(d))
    means = np.sort(d[picks].mean(axis=1))
    alpha = (1 - level) / 2
    rank = lambda p: float(means[min(iterations - 1, max(0, math.ceil(p * iterations) - 1))])
    return {"low": rank(alpha), "high": rank(1 - alpha), "bias": float(means.mean() - d.mean()), "se": float(means.std(ddof=1)) if iterations > 1 else 0.0}


#: Numbers that a task draws at once: a block of iterations has so many, or one iteration.
DRAWN = 2_000_000


def dealt_iterations(groups: DataFrame, iterations: Column, draw, out: str) -> DataFrame:
    """(key, first, out) for blocks of iterations of each group, dealt over the cluster; groups: (key, xs: the group's values in
    order), draw(xs, first, m) gives a list of what a block of m iterations from the first on comes to, as `out` names it."""
    size = F.greatest(F.lit(1), F.floor(F.lit(DRAWN) / F.greatest(F.lit(1), F.size("xs")))).cast("int")
    starts = F.when(iterations > 0, F.sequence(F.lit(0), iterations - 1, size)).otherwise(F.array().cast("array<int>"))
    blocks = groups.select("key", "xs", iterations.alias("all"), size.alias("size"), F.explode(starts).alias("first"))
    dealt = blocks.repartition("key", "first")
    kind = groups.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                xs, first = b.column(1)[i].values.to_numpy(), b.column(4)[i].as_py()
                got = draw(xs, first, min(b.column(3)[i].as_py(), b.column(2)[i].as_py() - first))
                n = len(got[0])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * n)), pa.array([first] * n, pa.int32()), *map(pa.array, got)], ["key", "first", *[c.split()[0] for c in out.split(", ")]])

    return dealt.mapInArrow(run, f"key {kind}, first int, {out}")


def resampled_means(xs: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Means of as many drawn samples as u has rows."""
    return xs[(u * len(xs)).astype(int)].mean(axis=1)


def compare_runs(metrics: DataFrame, metric: str, alpha: float = 0.05, iterations: int | None = None, query: str = "query_id", seed: int = COMPARISON_SEED) -> DataFrame:
    """(comparison, n, diff, p, low, high, significant): significant where p is below alpha and the interval excludes 0.

    metrics: (comparison, query, base, cand). Pairs with an undefined side are left out. The values of a comparison are one per
    query, in order of the query. Iterations are dealt in blocks, each of which starts its generators where it stands in the
    whole, so that a task draws a bounded number; results do not depend on the blocks. A comparison's means, one for each
    iteration, are sorted together.
    """
    both = metrics.filter("base is not null and cand is not null").withColumn("d", F.col("cand").cast("double") - F.col("base").cast("double"))
    groups = both.groupBy(F.col("comparison").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(query), "d"))), lambda x: x["d"]).alias("xs"))
    n = F.size("xs")
    few = (n <= EXACT) & F.exists("xs", lambda x: x != 0)
    signs, draws = iterations or 100_000, iterations or 10_000

    def extreme(xs: np.ndarray, first: int, m: int) -> list:
        u = mulberry32(seed, m * len(xs), first * len(xs)).reshape(m, len(xs))
        return [[int((np.abs(np.where(u < 0.5, xs, -xs).mean(axis=1)) >= abs(xs.mean()) - 1e-12).sum())]]

    def means(xs: np.ndarray, first: int, m: int) -> list:
        return [np.arange(first, first + m, dtype=np.int32), resampled_means(xs, mulberry32(seed, m * len(xs), first * len(xs)).reshape(m, len(xs)))]

    drawn = F.when(few | ~F.exists("xs", lambda x: x != 0), 0).otherwise(signs)
    extremes = dealt_iterations(groups, drawn, extreme, "extreme long").groupBy("key").agg(F.sum("extreme").alias("extreme"))
    sampled = dealt_iterations(groups, F.lit(draws), means, "i int, mean double").groupBy("key").agg(F.sort_array(F.collect_list("mean")).alias("means"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [b.column(1)[i].values.to_numpy() for i in range(b.num_rows)]
            p = [exact_sign_test(x) if len(x) <= EXACT and x.any() else None if x.any() else 1.0 for x in xs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in xs]), pa.array([float(x.mean()) for x in xs]), pa.array(p, pa.float64())], ["key", "n", "diff", "exact"])

    known = groups.mapInArrow(exact, f"comparison {groups.schema['key'].dataType.simpleString()}, n long, diff double, exact double")
    rank = lambda q: F.get("means", F.lit(min(draws - 1, max(0, math.ceil(q * draws) - 1))))
    tail = (1 - 0.95) / 2
    for part in (sampled.withColumnRenamed("key", "__s"), extremes.withColumnRenamed("key", "__s")):
        known = known.join(part, F.col("comparison").eqNullSafe(F.col("__s")), "left").drop("__s")
    p = F.coalesce("exact", (F.coalesce("extreme", F.lit(0)) + 1) / (signs + 1))
    out = known.select("comparison", "n", "diff", p.alias("p"), rank(tail).alias("low"), rank(1 - tail).alias("high"))
    return out.withColumn("significant", (F.col("p") < alpha) & ((F.col("low") > 0) | (F.col("high") < 0)))


def stratified(rows: DataFrame, strata: list[str], key: str, n: int, seed: str) -> DataFrame:
    """n rows, taken from the strata in turn; within a stratum in seeded order, strata in seeded order of their names."""
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata])
    order = Window.partitionBy(*strata).orderBy(seeded(seed, F.col(key)), key)
    numbered = rows.withColumns({"__turn": F.row_number().over(order), "__name": name})
    return numbered.orderBy("__turn", seeded(seed, F.col("__name")), "__name", seeded(seed, F.col(key))).limit(n).drop("__turn", "__name")


def staged_sample(stages: list[tuple[DataFrame, int | None]], rest: DataFrame, taken: DataFrame, by: str, key: str, quota: int, seed: str) -> DataFrame:
    """(by, key, stage, exhausted): quota new keys of each `by`, filled from stage to stage and at last from rest in seeded
    order; keys taken before are not taken again. exhausted: there were not enough.

    stages: ((by, key, priority), window): smaller priority first, and only the first `window` fresh keys of a stage count
    (None: all). rest: (by, key) of all keys that may be taken.
    """
    used = taken.select(by, key)
    whole = None
    for n, (stage, window) in enumerate(stages):
        fresh = stage.select(by, key, "priority").join(used, [by, key], "left_anti")
        fresh = fresh.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy("priority", key)).cast("string"))
        fresh = fresh.filter(F.col("__r").cast("int") <= window) if window else fresh
        part = fresh.select(by, key, F.lit(n).alias("stage"), F.lpad("__r", 12, "0").alias("__o"))
        whole = part if whole is None else whole.unionByName(part)
    drawn = rest.select(by, key).distinct().join(used, [by, key], "left_anti")
    last = drawn.select(by, key, F.lit(len(stages)).alias("stage"), seeded(seed, F.concat_ws("|", F.col(by), F.col(key))).alias("__o"))
    whole = last if whole is None else whole.unionByName(last)
    once = whole.groupBy(by, key).agg(F.min(F.struct("stage", "__o")).alias("m")).select(by, key, "m.*")
    placed = once.withColumn("__p", F.row_number().over(Window.partitionBy(by).orderBy("stage", "__o", key))).filter(F.col("__p") <= quota)
    return placed.withColumn("exhausted", F.count("*").over(Window.partitionBy(by)) < quota).select(by, key, "stage", "exhausted")


def adjudicated(a: DataFrame, b: DataFrame, choice: DataFrame, on: list[str]) -> DataFrame:
    """(on, a, b, agreed, grade): grade is the common one, else the adjudicator's, else null."""
    both = a.select(*on, F.col("grade").alias("a")).join(b.select(*on, F.col("grade").alias("b")), on).join(choice.select(*on, F.col("grade").alias("c")), on, "left")
    agreed = F.col("a") == F.col("b")
    return both.select(*on, "a", "b", agreed.alias("agreed"), F.when(agreed, F.col("a")).otherwise(F.col("c")).alias("grade"))


def blinded(rows: DataFrame, group: str, key: str, seed: str) -> tuple[DataFrame, DataFrame]:
    """(pack, mapping): rows under opaque ids, groups and rows within them in seeded orders (group_place, place), and the owner's table of
    (blind, group, key). The ids depend on the seed and the row only; the pack has neither group nor key."""
    name = F.concat_ws("|", F.col(group), F.col(key))
    ids = rows.select(F.concat(F.lit("b-"), F.substring(seeded(f"{seed}-id", name), 1, 16)).alias("blind"), group, key)
    groups = ids.select(group).distinct().withColumn("group_place", F.row_number().over(Window.orderBy(seeded(f"{seed}-group", F.col(group)), group)))
    place = F.row_number().over(Window.partitionBy(group).orderBy(seeded(f"{seed}-row", name), key))
    return ids.withColumn("place", place).join(groups, group).select("blind", "group_place", "place"), ids


def checks(named: dict[str, DataFrame]) -> DataFrame:
    """(name, observed, passed): each frame counts what breaks a rule; 0 passes."""
    out = None
    for name, broken in named.items():
        row = broken.agg(F.count("*").alias("observed")).select(F.lit(name).alias("name"), "observed", (F.col("observed") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


#: Rows of a table whose hashes are put together in 4096 groups; each further level of groups takes 4096 times as many.
HASHED_ROWS = 40_000_000


def artifact_hash(rows: DataFrame, order: list[str]) -> DataFrame:
    """A hash of a table that does not depend on the order of its rows.

    The digest is that of a tree: rows are hashed by their canonical JSON, keys in byte order, and the hashes are grouped by
    their first hex digits, three for each level. A group of the lowest level is the SHA-256 of its sorted row hashes, one
    above that of its sorted children, each after its digits, and the root that of the highest groups. The number of levels
    follows from the number of rows, so that a task holds about ten thousand hashes, or 4096 groups, however large the table is;
    exact copies of one row all fall into one group, which has no bound but their number.
    """
    line = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)])), 256)
    levels, most = 1, HASHED_ROWS
    n = rows.count()
    while n > most:
        levels, most = levels + 1, most * 4096
    joined = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ""), 256)
    parts = rows.select(line.alias("h")).groupBy(F.substring("h", 1, 3 * levels).alias("p")).agg(joined("h").alias("h"))
    for level in range(levels - 1, 0, -1):
        parts = parts.groupBy(F.substring("p", 1, 3 * level).alias("up")).agg(joined(F.concat("p", "h")).alias("h")).withColumnRenamed("up", "p")
    return parts.agg(joined(F.concat("p", "h")).alias("sha256"))


def gates(facts: dict[str, bool]) -> dict[str, object]:
    return {"passed": all(facts.values()), "blocked_by": [k for k, v in facts.items() if not v]}



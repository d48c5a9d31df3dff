"""Release reports: suite aggregates, stratified agreement, profile facts, gates, named checks, dataset and record checks."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import ATOMIC_TOKEN, seeded, tokens
from tessera.operators.evaluation import dealt_iterations, lcg

#: Fixed value: the seed of release intervals.
RELEASE_SEED = 0x5EED1234


def violations(run: DataFrame, planted: DataFrame, cutoffs: tuple[int, ...], query: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, k, violations): results within each cutoff that are among the planted pairs (query, key)."""
    hit = run.join(planted.select(query, key).distinct(), [query, key], "left_semi")
    cuts = F.explode(F.array(*map(F.lit, cutoffs))).alias("k")
    counted = hit.groupBy(query).agg(*[F.count_if(F.col("rank") <= k).alias(f"v{k}") for k in cutoffs])
    value = F.coalesce(*[F.when(F.col("k") == k, F.col(f"v{k}")) for k in cutoffs], F.lit(0))
    return run.select(query).distinct().select(query, cuts).join(counted, query, "left").select(query, "k", value.alias("violations"))


def suite(scores: DataFrame, by: list[str]) -> DataFrame:
    """Suite aggregate where undefined counts as given: means over queries with a relevant document (0 without any), sums of
    violations, unjudged share, share of empty results, accuracy of expected emptiness.

    scores: by, relevant, returned, recall, precision, ndcg, mrr, unjudged, violations, expects_none, k; one row per query and k.
    """
    ranking = F.col("relevant") > 0
    mean = lambda c: F.coalesce(F.avg(F.when(ranking, F.col(c))), F.lit(0.0)).alias(c)
    shown = F.sum(F.least("k", "returned"))
    right = F.when(F.col("expects_none"), F.col("returned") == 0).otherwise(F.col("returned") > 0)
    return scores.groupBy(*by).agg(
        F.count("*").alias("queries"), F.count_if(ranking).alias("ranking_queries"), *[mean(c) for c in ("recall", "precision", "ndcg", "mrr")], F.sum("violations").alias("violations"),
        F.when(shown > 0, F.sum("unjudged") / shown).otherwise(0.0).alias("unjudged_rate"), F.avg((F.col("returned") == 0).cast("int")).alias("no_result_rate"), F.avg(right.cast("int")).alias("no_result_accuracy"),
    )


def suite_with_support(scores: DataFrame, by: list[str]) -> DataFrame:
    """Suite aggregate where undefined stays null: means with their support, violations a query, unjudged share, accuracy among
    queries that expect no result and share of results among the others; null where there is none."""
    shown = F.sum(F.least("k", "returned"))
    means = [c for n in ("recall", "precision", "ndcg", "mrr", "bpref") for c in (F.avg(n).alias(n), F.count(n).alias(f"{n}_support"))]
    empty = F.col("returned") == 0
    return scores.groupBy(*by).agg(
        F.count("*").alias("queries"), *means, F.when(shown > 0, F.sum("unjudged") / shown).alias("unjudged_rate"), F.sum("violations").alias("violations"), (F.sum("violations") / F.count("*")).alias("violations_per_query"),
        F.count_if("expects_none").alias("no_result_queries"), F.avg(F.when(F.col("expects_none"), empty.cast("int"))).alias("no_result_accuracy"), F.avg(F.when(~F.col("expects_none"), (~empty).cast("int"))).alias("has_result_rate"),
    )


def lift(baseline: DataFrame, candidate: DataFrame, on: list[str], measures: tuple[str, ...] = ("recall", "ndcg", "mrr")) -> DataFrame:
    b = baseline.select(*on, *[F.col(m).alias(f"__{m}") for m in measures])
    return candidate.join(b, on).select(*on, *[(F.col(m) - F.col(f"__{m}")).alias(m) for m in measures])


def agreement(pairs: DataFrame, by: str, grades: int = 4) -> DataFrame:
    """(by, n, exact, within_one, severe, kappa_quadratic, kappa_linear) of grade pairs (a, b) in each stratum; kappa is null where
    no disagreement is expected."""
    cells = pairs.groupBy(by, "a", "b").agg(F.count("*").alias("c"))
    gap = F.abs(F.col("a") - F.col("b"))
    seen = cells.groupBy(by).agg(
        F.sum("c").alias("n"), *[F.sum(F.when(t, F.col("c")).otherwise(0)).alias(x) for x, t in (("exact", gap == 0), ("within_one", gap <= 1), ("severe", gap >= 2))],
        F.sum(gap * F.col("c")).alias("o1"), F.sum(gap * gap * F.col("c")).alias("o2"),
    )
    rows, columns = cells.groupBy(by, "a").agg(F.sum("c").alias("r")), cells.groupBy(by, "b").agg(F.sum("c").alias("m"))
    chance = rows.join(columns, by).groupBy(by).agg(F.sum(gap * F.col("r") * F.col("m")).alias("e1"), F.sum(gap * gap * F.col("r") * F.col("m")).alias("e2"))
    kappa = lambda o, e: F.when(F.col(e) > 0, 1 - F.col(o) * F.col("n") / F.col(e))
    shares = [(F.col(x) / F.col("n")).alias(x) for x in ("exact", "within_one", "severe")]
    return seen.join(chance, by).select(by, "n", *shares, kappa("o2", "e2").alias("kappa_quadratic"), kappa("o1", "e1").alias("kappa_linear"))


def stratified_agreement(pairs: DataFrame, target: float = 0.6) -> DataFrame:
    """agreement() over all pairs, over those of a relevant family and over the rest, with each stratum's share, and inflation (kappa of
    all less kappa of the relevant family) and passes (the family's kappa reaches the target) beside every row.

    pairs: (a, b, family); a null family is one where either grade is 1 or more.
    """
    family = F.coalesce("family", F.greatest("a", "b") >= 1)
    strata = pairs.select("a", "b", F.explode(F.array(F.lit("all"), F.when(family, "relevant").otherwise("other"))).alias("stratum"))
    each = agreement(strata, "stratum")
    pick = lambda s, c: F.max(F.when(F.col("stratum") == s, F.col(c)))
    facts = each.agg(pick("all", "kappa_quadratic").alias("ka"), pick("relevant", "kappa_quadratic").alias("kr"), pick("all", "n").alias("total"))
    return each.crossJoin(F.broadcast(facts)).select(*each.columns, (F.col("n") / F.col("total")).alias("share"), (F.col("ka") - F.col("kr")).alias("inflation"), F.coalesce(F.col("kr") >= target, F.lit(False)).alias("passes"))


def boundary(pairs: DataFrame) -> DataFrame:
    """Pairs of which a grade is 2 or more: their disagreement, the confusion of 2 with 3, and those that cross the relevance cutoff."""
    b = pairs.filter(F.greatest("a", "b") >= 2)
    two = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    return b.agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("disagreements"), two(2, 3).alias("a_two_b_three"), two(3, 2).alias("a_three_b_two"), F.count_if(F.least("a", "b") <= 1).alias("crossing")).withColumn(
        "disagreement_rate", F.when(F.col("n") > 0, F.col("disagreements") / F.col("n"))
    )


def release_intervals(values: DataFrame, by: str, value: str, order: str, samples: int = 1000, seed: int = RELEASE_SEED) -> DataFrame:
    """(by, n, mean, low, high): the interval of a mean by the report's own generator. A group has one value per query, in order of
    the query; null values are left out. Samples are dealt in blocks, each of which starts the generator where it stands in
    the whole; a group's means, one a sample, are sorted together."""
    given = values.filter(F.col(value).isNotNull())
    groups = given.groupBy(F.col(by).alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).cast("double").alias("x")))), lambda v: v["x"]).alias("xs"))

    def draw(xs: np.ndarray, first: int, m: int) -> list:
        picks = (lcg(seed, m * len(xs), first * len(xs)) * len(xs)).astype(int).reshape(m, len(xs))
        return [xs[picks].sum(axis=1) / len(xs)]

    means = dealt_iterations(groups, F.lit(samples), draw, "mean double").groupBy("key").agg(F.sort_array(F.collect_list("mean")).alias("means"))
    facts = groups.select(F.col("key").alias("k"), F.size("xs").cast("long").alias("n"), (F.aggregate("xs", F.lit(0.0), lambda a, x: a + x) / F.size("xs")).alias("mean"))
    joined = facts.join(means.withColumnRenamed("key", "__m"), F.col("k").eqNullSafe(F.col("__m")))
    return joined.select(F.col("k").alias(by), "n", "mean", F.get("means", F.lit(int(samples * 0.025))).alias("low"), F.get("means", F.lit(int(samples * 0.975))).alias("high"))


def profile_facts(results: DataFrame, records: DataFrame, qrels: DataFrame, queries: DataFrame) -> DataFrame:
    """One row of a profile: grade-0 rate, hard and soft constraint violation rates, adversarial first places and those resisted, warm
    and cold shares, provider concentration in the first five.

    results: (query, key, rank, hard_ok, soft_ok); records: (key, provider, adversarial, freshness); qrels: (query, key, grade);
    queries: (query, adversarial_query). Rates over nothing are 0.
    """
    rows = results.join(records, "key").join(qrels.select("query", "key", "grade"), ["query", "key"], "left").join(queries, "query")
    grade, first, hostile = F.coalesce("grade", F.lit(0)), F.col("rank") == 1, F.col("adversarial_query")
    totals = rows.agg(
        F.count("*").alias("returned"), F.count_if(grade == 0).alias("zero"), F.count_if(~F.col("hard_ok")).alias("hard"), F.count_if(F.col("hard_ok") & ~F.col("soft_ok")).alias("soft"),
        F.count_if(first & hostile & F.col("adversarial")).alias("top1"), F.count_if(first & hostile & ~F.col("adversarial") & (grade >= 2)).alias("resisted"),
        F.count_if(F.col("freshness") == "warm").alias("warm"), F.count_if(F.col("freshness") == "cold").alias("cold"),
    )
    asked = queries.agg(F.count("*").alias("q"), F.count_if("adversarial_query").alias("hq"))
    most = rows.filter("rank <= 5").groupBy("provider").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    rate = lambda c, n: (F.col(c) / F.greatest(F.lit(1), F.col(n))).alias
    return totals.crossJoin(asked).crossJoin(most).select(
        "returned", rate("zero", "returned")("grade_zero_rate"), rate("hard", "returned")("hard_violation_rate"), rate("soft", "returned")("soft_violation_rate"), rate("top1", "hq")("adversarial_top1_rate"),
        rate("resisted", "hq")("adversarial_resistance_rate"), rate("warm", "returned")("warm_share"), rate("cold", "returned")("cold_share"), (F.col("most") / F.greatest(F.lit(1), 5 * F.col("q"))).alias("provider_concentration"),
    )


def subset_recall(results: DataFrame, records: DataFrame, qrels: DataFrame, kind: str, k: int = 20) -> DataFrame:
    """(kind, queries, recall): mean recall at k over the relevant documents of each value of a record's `kind`, such as fresh or old."""
    relevant = qrels.filter("grade >= 2").join(records.select("key", kind), "key")
    top = results.filter(F.col("rank") <= k).select("query", "key", F.lit(1).alias("__hit"))
    per = relevant.join(top, ["query", "key"], "left").groupBy(kind, "query").agg((F.count("__hit") / F.count("*")).alias("r"))
    return per.groupBy(kind).agg(F.count("*").alias("queries"), F.avg("r").alias("recall"))


def gate_table(profiles: DataFrame, facts: dict[str, bool], hybrid_limit_ms: float, reranked_limit_ms: float) -> DataFrame:
    """(gate, passed): release gates over profiles (name, hard_rate, soft_rate, fallbacks, ndcg, recall, no_result_accuracy, top1_rate, p95_ms,
    rerank_rate). Facts that are not of a profile come as given. A gate of a profile that is missing fails."""
    p = {n: F.max(F.when(F.col("name") == n, F.struct(*profiles.columns))) for n in ("lexical", "hybrid", "reranked")}
    one = profiles.agg(F.count_if(F.col("hard_rate") != 0).alias("hard"), F.count_if(F.col("soft_rate") != 0).alias("soft"), F.count_if(F.col("fallbacks") != 0).alias("fell"), *[c.alias(n) for n, c in p.items()])
    g = lambda n, c: F.col(n)[c]
    gates = {
        "hard_violations_zero": F.col("hard") == 0, "soft_violations_zero": F.col("soft") == 0, "fallbacks_zero": F.col("fell") == 0,
        "hybrid_beats_lexical_ndcg": g("hybrid", "ndcg") > g("lexical", "ndcg"), "hybrid_beats_lexical_recall": g("hybrid", "recall") > g("lexical", "recall"), "reranker_executed": g("reranked", "rerank_rate") == 1,
        "reranker_matches_hybrid_ndcg": g("reranked", "ndcg") >= g("hybrid", "ndcg"), "reranker_matches_hybrid_recall": g("reranked", "recall") >= g("hybrid", "recall"),
        **{f"{n}_no_result_accuracy_perfect": g(n, "no_result_accuracy") == 1 for n in ("hybrid", "reranked")}, **{f"{n}_top1_rate_zero": g(n, "top1_rate") == 0 for n in ("hybrid", "reranked")},
        "hybrid_p95_within_limit": g("hybrid", "p95_ms") <= hybrid_limit_ms, "reranked_p95_within_limit": g("reranked", "p95_ms") <= reranked_limit_ms,
    }
    rows = [F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in gates.items()]
    rows += [F.struct(F.lit(n).alias("gate"), F.lit(bool(v)).alias("passed")) for n, v in facts.items()]
    return one.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def tag_spread(rows: DataFrame, tags: list[str], baseline: str, axes: list[str], concentrated: list[str]) -> DataFrame:
    """(tag, n, distinct_<axis>, max_<axis> for concentrated axes, drift): how rows with a tag (a boolean column) spread over the axes,
    and the largest difference of a baseline value's share among them from its share among all; one pass over pre-aggregated rows."""
    tagged = rows.select("*", F.explode(F.array(F.lit("all"), *[F.when(F.col(t), F.lit(t)) for t in tags])).alias("tag")).filter("tag is not null")
    facts = tagged.groupBy("tag").agg(F.count("*").alias("n"), *[F.count_distinct(a).alias(f"distinct_{a}") for a in axes])
    for a in concentrated:
        most = tagged.groupBy("tag", a).agg(F.count("*").alias("c")).groupBy("tag").agg(F.max("c").alias(f"max_{a}"))
        facts = facts.join(most, "tag")
    cells = tagged.groupBy("tag", baseline).agg(F.count("*").alias("c"))
    shares = cells.withColumn("s", F.col("c") / F.sum("c").over(Window.partitionBy("tag")))
    whole = shares.filter("tag = 'all'").select(baseline, F.col("s").alias("w"))
    grid = facts.select("tag").crossJoin(F.broadcast(whole)).join(shares.select("tag", baseline, "s"), ["tag", baseline], "left")
    drift = grid.groupBy("tag").agg(F.max(F.abs(F.coalesce("s", F.lit(0.0)) - F.col("w"))).alias("drift"))
    return facts.join(drift, "tag")


def verdicts(observed: DataFrame, limits: dict[str, tuple[str, float, float]]) -> DataFrame:
    """(name, value, passed) of named measures in one row; limits: name to (column, least, most). A null value does not pass. The release is
    blocked where a row has not passed."""
    rows = [F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"), F.coalesce(F.col(c).between(lo, hi), F.lit(False)).alias("passed")) for n, (c, lo, hi) in limits.items()]
    return observed.select(F.explode(F.array(*rows)).alias("v")).select("v.*")


def input_issues(queries: DataFrame, runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """(issue, n) of report inputs: missing and unknown queries of a system, repeated ranks and results, repeated judgments.

    queries: (query); runs: (system, query, key, rank); qrels: (query, key).
    """
    grid = runs.select("system").distinct().crossJoin(queries.select("query").distinct())
    found = {
        "missing_query": grid.join(runs.select("system", "query").distinct(), ["system", "query"], "left_anti"),
        "unknown_query": runs.select("system", "query").distinct().join(queries, "query", "left_anti"),
        "repeated_rank": runs.groupBy("system", "query", "rank").agg(F.count("*").alias("c")).filter("c > 1"),
        "repeated_result": runs.groupBy("system", "query", "key").agg(F.count("*").alias("c")).filter("c > 1"),
        "repeated_judgment": qrels.groupBy("query", "key").agg(F.count("*").alias("c")).filter("c > 1"),
    }
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("issue"), "n") for n, d in found.items()]
    return reduce(DataFrame.unionByName, parts)


def rates_agree(reviewed: Column, part: Column, told: Column, tolerance: float = 1e-12) -> Column:
    """Whether a stated rate is part / reviewed (0 of none) within the tolerance."""
    return F.abs(told - F.when(reviewed == 0, 0.0).otherwise(part / reviewed)) <= tolerance


def recommendation_facts(top: DataFrame, records: DataFrame, judgments: DataFrame) -> DataFrame:
    """One row over each query's first five: constraint violations, unsafe results, unjudged results, cold-start share, concentration.

    top: (query, key, rank); records: (key, origin, volume, unsafe); judgments: (query, key, eligibility). Keys without a record
    are left out.
    """
    rows = top.filter("rank <= 5").join(records, "key").join(judgments.select("query", "key", "eligibility"), ["query", "key"], "left")
    facts = rows.agg(
        F.count("*").alias("shown"), F.count_if(F.col("eligibility").isNotNull() & (F.col("eligibility") != "eligible")).alias("violations"), F.count_if("unsafe").alias("unsafe"),
        F.count_if(F.col("eligibility").isNull()).alias("unjudged"), F.count_if(F.coalesce("volume", F.lit(0)) == 0).alias("cold"),
    )
    most = rows.groupBy("origin").agg(F.count("*").alias("c")).agg(F.coalesce(F.max("c"), F.lit(0)).alias("most"))
    share = lambda c: F.when(F.col("shown") > 0, F.col(c) / F.col("shown")).otherwise(0.0)
    return facts.crossJoin(most).select("shown", "violations", "unsafe", "unjudged", share("cold").alias("cold_share"), share("most").alias("concentration"))


def _rate(flag: Column) -> Column:
    """Share of true where a flag is known; 0 where it is nowhere."""
    return F.coalesce(F.avg(flag.cast("int")), F.lit(0.0))


def operational_metrics(outcomes: DataFrame) -> DataFrame:
    """One row over the outcomes that were attempted: rates, mean and 95th percentile of latency, mean cost; selected counts all outcomes.

    outcomes: attempted, selected, payment_verification, settlement, invocation (texts), response_valid, task_success (null:
    unknown), latency_ms, total_cost_usd. A verification, settlement or invocation that is not known has not passed. What is
    asked of nothing is 0. The percentile is the nearest rank.
    """
    c = F.col
    tried = outcomes.filter("attempted")
    passed = lambda n: _rate(F.coalesce(c(n) == "pass", F.lit(False)))
    facts = tried.agg(
        F.count("*").alias("attempted"), passed("payment_verification").alias("payment_verification_rate"), passed("settlement").alias("settlement_rate"), passed("invocation").alias("invocation_rate"), _rate(c("response_valid")).alias("response_valid_rate"), _rate(c("task_success")).alias("task_success_rate"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("mean_latency_ms"), F.coalesce(F.expr("percentile_disc(0.95) within group (order by latency_ms)").cast("double"), F.lit(0.0)).alias("p95_latency_ms"), F.coalesce(F.avg("total_cost_usd"), F.lit(0.0)).alias("mean_cost_usd"),
    )
    return facts.crossJoin(outcomes.agg(F.count_if("selected").alias("selected")))


def failure_reasons(outcomes: DataFrame) -> DataFrame:
    """(failure_reason, n) of the outcomes that were attempted and tell one."""
    return outcomes.filter(F.col("attempted") & (F.coalesce("failure_reason", F.lit("")) != "")).groupBy("failure_reason").agg(F.count("*").alias("n"))


def class_metrics(queries: DataFrame, metrics: DataFrame, runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(class, queries, evaluable, ndcg_at_5, task_success_rate) by class of query.

    queries: (query, class); metrics: (query, relevant, ndcg) at a cutoff of 5; runs: (query, key, rank, selected: null or
    whether it was taken); outcomes: (query, key, seq, task_success). A query is evaluable if a relevant result is judged; nDCG is
    the mean over these, an undefined one as 0. A query's outcome is the first, by seq, of its selected result, or of the first
    result where none was selected; success is the share of true among known outcomes. Means and rates of nothing are 0.
    """
    taken = runs.groupBy("query").agg(F.min_by("key", F.struct(~F.coalesce("selected", F.lit(False)), "rank")).alias("key"))
    first = outcomes.groupBy("query", "key").agg(F.min_by(F.struct("task_success"), "seq").alias("o"))
    told = taken.join(first, ["query", "key"]).select("query", F.col("o.task_success").alias("success"))
    rows = queries.select("query", "class").join(metrics.select("query", "relevant", "ndcg"), "query", "left").join(told, "query", "left")
    evaluable = F.coalesce(F.col("relevant") > 0, F.lit(False))
    return rows.groupBy("class").agg(
        F.count("*").alias("queries"), F.count_if(evaluable).alias("evaluable"), F.coalesce(F.avg(F.when(evaluable, F.coalesce("ndcg", F.lit(0.0)))), F.lit(0.0)).alias("ndcg_at_5"), _rate(F.col("success")).alias("task_success_rate")
    )


def family_gates(members: DataFrame, family: str, capability: str, size: int) -> DataFrame:
    """(family, n, capabilities, passed): families must have `size` members of as many different capabilities."""
    per = members.groupBy(family).agg(F.count("*").alias("n"), F.count_distinct(capability).alias("capabilities"))
    return per.withColumn("passed", (F.col("n") == size) & (F.col("capabilities") == size))


def liveness(records: DataFrame, state: str = "liveness") -> DataFrame:
    c = F.coalesce(F.col(state), F.lit("unknown"))
    return records.agg(F.count_if(c != "unknown").alias("observed"), F.count_if(c == "pass").alias("passed"), F.count_if(c == "fail").alias("failed"), F.count_if(c == "unknown").alias("unknown"))


def sidecar_issues(sidecars: DataFrame, options: DataFrame, key: str = "key") -> DataFrame:
    """(key, issues) of sidecars that do not say what their record's options do: scheme_set, networks, price, sparse.

    sidecars: (key, scheme_set, networks, price, is_sparse, described); options: (key, scheme, network, amount). A record of no option
    implies no networks and no price.
    """
    has = lambda s: F.max((F.col("scheme") == s).cast("int")) == 1
    implied = F.when(has("upto") & has("exact"), "exact_and_upto").when(has("upto"), "upto_only").otherwise("exact_only")
    real = options.groupBy(key).agg(implied.alias("__s"), F.sort_array(F.collect_set("network")).alias("__n"), F.min("amount").alias("__p"))
    j = sidecars.join(real, key, "left")
    rules = {
        "scheme_set": F.col("scheme_set") != F.coalesce("__s", F.lit("exact_only")), "networks": F.sort_array("networks") != F.coalesce("__n", F.array().cast("array<string>")),
        "price": F.col("__p").isNull() | (F.abs(F.col("price") - F.col("__p")) > 1e-9), "sparse": F.col("is_sparse") & F.col("described"),
    }
    return j.select(key, F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])).alias("issues")).filter(F.size("issues") > 0)


def cohort_queries(queries: DataFrame, order: str, prefix: str = "eco-qry-", rename: dict[str, str] | None = None) -> DataFrame:
    """Queries of one cohort in the shape of another: ids numbered in order, classes renamed, constraint maps merged over the filters
    (later keys win, nulls are left out). queries: order, query_class, text, filters, constraints (maps of text).

    Ids are numbered over all queries, so this orders the query set as a whole, which is of stated size.
    """
    n = F.row_number().over(Window.orderBy(order))
    name = reduce(lambda acc, kv: F.when(F.col("query_class") == kv[0], kv[1]).otherwise(acc), (rename or {}).items(), F.col("query_class"))
    kept = lambda m: F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    mine = F.map_filter(kept(F.col("filters")), lambda k, v: ~F.map_contains_key(kept(F.col("constraints")), k))
    return queries.select(order, F.concat(F.lit(prefix), F.lpad(n.cast("string"), 4, "0")).alias("query_id"), name.alias("query_class"), "text", F.map_concat(mine, kept(F.col("constraints"))).alias("filters"))


def metadata_issues(name: Column, tags: Column, icon: Column, description: Column, mime: Column, method: Column, has_body: Column) -> Column:
    """All failures of a seller's metadata, in order: name, tags, icon, description, mime, method, body. Null fields are not given."""
    plain = r"^[\x20-\x7E]{1,32}$"
    rules = {
        "name": ~F.regexp_like(name, F.lit(plain)),
        "tags": (F.size(tags) > 5) | (F.size(F.array_distinct(tags)) < F.size(tags)) | F.exists(tags, lambda t: ~F.regexp_like(t, F.lit(plain))),
        "icon": ~F.regexp_like(icon, F.lit(r"^https?://(?!localhost|127\.|10\.|192\.168\.)[^/\s]+")), "description": F.trim(description) == "", "mime": ~F.regexp_like(mime, F.lit(r"^[\w.+-]+/[\w.+-]+$")),
        "method": ~method.isin("GET", "HEAD", "DELETE", "POST", "PUT", "PATCH"), "body": has_body & ~method.isin("POST", "PUT", "PATCH"),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that is true, null where none is; null counts as false."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules])


#: What every declaration has to be, whatever its own schema says; words and names are fixed values.
DECLARATION = {
    "type": "object", "required": ["info"],
    "properties": {
        "info": {"type": "object", "required": ["input"], "properties": {
            "input": {"type": "object", "required": ["type"], "properties": {
                "type": {"enum": ["http", "mcp"]}, "method": {"enum": ["GET", "HEAD", "DELETE", "POST", "PUT", "PATCH"]}, "bodyType": {"enum": ["json", "form-data", "text"]},
                "toolName": {"type": "string"}, "inputSchema": {"type": "object"},
            }},
            "output": {"type": "object"},
        }},
        "schema": {"type": "object"},
    },
}


def extraction(body: Column, limits: dict[str, int]) -> Column:
    """struct(code, dropped) of a candidate's JSON: the first reject code, and optional fields that are dropped without rejecting.

    Codes in order: absent, not_an_object, metadata_too_large, metadata_too_deep, spec_invalid, schema_invalid, schema_too_large, example_too_large,
    url_missing, url_malformed, url_scheme, url_credentials, url_private_host, tool_missing. limits: metadata, depth, schema, example (bytes and
    levels), description, tag and tags. The object is under $.extension, the URL in $.resource.url. spec_invalid is what DECLARATION does
    not allow; schema_invalid is an info that the declaration's own schema, if there is one, does not allow, to limits["depth"] levels.
    """
    from tessera.functions.json_schema import violations
    from tessera.functions.urls import rejection

    at = lambda p: F.get_json_object(body, f"$.{p}")
    ext, url, kind = at("extension"), at("resource.url"), F.coalesce(at("extension.info.input.type"), F.lit("http"))
    size = lambda c, most: F.coalesce(F.octet_length(c) > most, F.lit(False))
    # levels of nesting: the deepest run of opening brackets that are not closed, outside strings
    bare = F.regexp_replace(ext, r'"(?:\\.|[^"\\])*"', "")
    steps = F.regexp_extract_all(bare, F.lit(r"[\[{\]}]"), F.lit(0))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, c: F.struct((a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most")))["most"]
    url_code = rejection(url)
    rules = [
        ("absent", ext.isNull()), ("not_an_object", ~F.startswith(F.trim(ext), F.lit("{"))), ("metadata_too_large", size(ext, limits["metadata"])), ("metadata_too_deep", depth > limits["depth"]),
        ("spec_invalid", F.size(violations(F.lit(json.dumps(DECLARATION)), ext, limits["depth"])) > 0), ("schema_invalid", F.size(violations(at("extension.schema"), at("extension.info"), limits["depth"])) > 0), ("schema_too_large", size(at("extension.schema"), limits["schema"])),
        ("example_too_large", size(at("extension.info.input.example"), limits["example"]) | size(at("extension.info.output.example"), limits["example"])),
        ("url_missing", F.coalesce(url, F.lit("")) == ""), *[(f"url_{c}", url_code == c) for c in ("malformed", "scheme", "credentials", "private_host")],
        ("tool_missing", (kind == "mcp") & at("extension.info.input.toolName").isNull()),
    ]
    tags = F.from_json(at("resource.tags"), "array<string>")
    soft = {
        "routeTemplate": at("extension.routeTemplate").isNotNull() & ~F.regexp_like(at("extension.routeTemplate"), F.lit(r"^/(?!.*(?:\.\.|//))[\w\-./:{}%]*$")),
        "description": at("resource.description").isNotNull() & (F.trim(at("resource.description")) == ""), "mimeType": at("resource.mimeType").isNotNull() & ~F.regexp_like(at("resource.mimeType"), F.lit(r"^[\w.+-]+/[\w.+-]+$")),
        "tags": at("resource.tags").isNotNull() & tags.isNull(),
    }
    code = first_reason(rules)
    dropped = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in soft.items()]))
    return F.struct(code.alias("code"), F.when(code.isNull(), dropped).otherwise(F.array().cast("array<string>")).alias("dropped"))


#: Fields of external records by meaning, in order of preference.
EXTERNAL_FIELDS = {
    "url": ("resource", "url", "endpoint", "serviceUrl", "metadata.resource"), "name": ("serviceName", "service_name", "name", "title", "metadata.serviceName", "metadata.name"),
    "description": ("description", "metadata.description", "metadata.summary"), "updated": ("lastUpdated", "last_updated", "updatedAt"),
}


def external_record(body: Column, fields: dict[str, tuple[str, ...]] | None = None) -> Column:
    """struct of an external record's fields, each the first of its names that holds a value that is not blank; url is normalised and null
    where it is no URL; key is its transport and URL; liveness, safety and status follow from the record's flags."""
    from tessera.functions.json_schema import let
    from tessera.functions.urls import normalize

    # a name is looked up once at most: each look-up reads the body anew
    at = lambda n: let(F.trim(F.get_json_object(body, f"$.{n}")), lambda t: F.when(t != "", t))
    first = lambda names: F.coalesce(*map(at, names))
    given = {k: first(names) for k, names in (fields or EXTERNAL_FIELDS).items()}
    given |= {"__told": F.lower(first(("type", "transport", "metadata.type", "metadata.transport")))}
    given |= {"__live": first(("liveness", "healthy", "health.status", "health.healthy")), "__safe": first(("safety", "safetyStatus", "safety_status"))}
    flag = lambda x, good, bad: F.when(x.isin("true", "pass", good), "pass").when(x.isin("false", "fail", bad), "fail").otherwise("unknown")

    def judged(f: Column) -> Column:
        told = f["__told"]
        transport = F.when(told.isin("http", "mcp", "a2a"), told).when(F.contains(told, F.lit("mcp")), "mcp").when(F.contains(told, F.lit("a2a")) | F.contains(told, F.lit("agent")), "a2a").otherwise("http")
        seen = F.struct(normalize(f["url"]).alias("url"), flag(f["__live"], "healthy", "unhealthy").alias("live"), flag(f["__safe"], "safe", "unsafe").alias("safe"))
        return let(seen, lambda s: record(f, transport, s["url"], s["live"], s["safe"]))

    def record(f: Column, transport: Column, url: Column, live: Column, safe: Column) -> Column:
        status = F.when(safe == "fail", "unsafe").when(live == "fail", "unreachable").when((at("stale") == "true") | (at("status") == "stale"), "stale").when(live == "pass", "active").otherwise("unknown")
        return F.struct(url.alias("url"), F.concat(transport, F.lit(":"), url).alias("key"), F.substring(f["name"], 1, 512).alias("name"), F.substring(f["description"], 1, 8000).alias("description"), f["updated"].alias("updated"), live.alias("liveness"), safe.alias("safety"), status.alias("status"))

    return let(F.struct(*[c.alias(k) for k, c in given.items()]), judged)


def external_details(body: Column) -> Column:
    """struct of what an external record tells of itself: tags and categories (texts that are not blank, once each, the first 100), accepts
    (payment options with an amount, a scheme, a network and an asset, the first 20), payment (pass, fail, unknown), response_valid,
    latency_ms, failure_reason, and of its quality calls, buyers, last_called (UTC), completeness (0, 0.5 or 1), provider_score,
    trust_score and grade.

    Of several names for a thing the first that is there counts, also where its value is of no use; where a text is asked for, the first
    that is a text and not blank. Numbers in quotes are no numbers, but for timeouts. Malformed bodies have nothing.
    """
    from tessera.functions.json_schema import let

    return let(F.try_parse_json(body), _details)


def _details(v: Column) -> Column:
    from tessera.functions.json_schema import kind, let

    at = lambda path, of=v: F.try_variant_get(of, f"$.{path}", "variant")
    there = lambda x: F.when(x.isNotNull() & (kind(x) != "null"), x)
    given = lambda *paths, of=v: F.coalesce(*[let(at(p, of), there) for p in paths])
    plain = lambda x: F.trim(F.try_variant_get(x, "$", "string"))
    text = lambda x: F.when(kind(x) == "string", F.nullif(plain(x), F.lit("")))
    texts = lambda *paths, of=v: F.coalesce(*[let(at(p, of), text) for p in paths])
    number = lambda x: F.when(kind(x) == "number", F.try_variant_get(x, "$", "double"))
    numbers = lambda *paths: let(given(*paths), number)
    whole = lambda *paths: let(numbers(*paths), lambda n: F.when((n >= 0) & (n == F.floor(n)), n.cast("long")))
    none = F.array().cast("array<string>")

    def strings(x: Column) -> Column:
        many = F.slice(F.array_distinct(F.array_compact(F.transform(F.try_variant_get(x, "$", "array<variant>"), text))), 1, 100)
        return F.coalesce(F.when(kind(x) == "string", let(text(x), lambda t: F.when(t.isNotNull(), F.array(t)))).when(kind(x) == "array", many), none)

    def date(x: Column) -> Column:
        stamp = F.to_utc_timestamp(F.when(kind(x) == "string", F.try_variant_get(x, "$", "string")).try_cast("timestamp"), F.current_timezone())
        return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def option(o: Column) -> Column:
        seconds = let(given("maxTimeoutSeconds", "max_timeout_seconds", of=o), lambda t: F.coalesce(number(t), text(t).try_cast("double")))
        found = F.struct(
            texts("scheme", of=o).alias("scheme"), texts("network", "chain", of=o).alias("network"), texts("asset", "currency", of=o).alias("asset"), texts("amount", "maxAmountRequired", "max_amount_required", of=o).alias("amount"),
            texts("payTo", "pay_to", of=o).alias("pay_to"), let(seconds, lambda n: F.when((n > 0) & (n == F.floor(n)) & (n < 2.0**53), n.cast("long"))).alias("max_timeout_seconds"),
        )
        return let(found, lambda f: F.when(F.concat(*[f[n] for n in ("scheme", "network", "asset", "amount")]).isNotNull(), f))

    listed = lambda x: F.when(kind(x) == "array", F.try_variant_get(x, "$", "array<variant>"))
    lists = [let(at(n), listed) for n in ("accepts", "paymentOptions", "payment_options", "metadata.accepts")]
    options = F.slice(F.array_compact(F.transform(F.coalesce(*lists), option)), 1, 20)
    payment = let(F.to_json(given("payment", "onChainDemand", "on_chain_demand")), lambda x: F.when(x.isin("true", '"pass"'), "pass").when(x.isin("false", '"fail"'), "fail").otherwise("unknown"))
    valid = F.coalesce(*[let(at(n), lambda x: F.when(kind(x) == "boolean", F.try_variant_get(x, "$", "boolean"))) for n in ("responseValid", "response_valid")])
    schema = given("metadata.input", "metadata.output", "inputSchema", "outputSchema", "schema").isNotNull()
    complete = F.when(texts("description", "metadata.description").isNotNull(), 0.5).otherwise(0.0) + F.when(schema, 0.5).otherwise(0.0)
    kinds = "array<struct<scheme:string,network:string,asset:string,amount:string,pay_to:string,max_timeout_seconds:bigint>>"
    return F.struct(
        let(given("tags", "metadata.tags"), strings).alias("tags"), let(given("categories", "category", "metadata.category"), strings).alias("categories"), F.coalesce(options, F.array().cast(kinds)).alias("accepts"), payment.alias("payment"), valid.alias("response_valid"),
        numbers("latencyMs", "latency_ms", "health.latencyMs").alias("latency_ms"), F.substring(texts("failureReason", "failure_reason", "health.error"), 1, 1000).alias("failure_reason"),
        whole("quality.l30DaysTotalCalls", "quality.totalCalls30d", "stats.calls24h", "calls24h").alias("calls"), whole("quality.l30DaysUniquePayers", "quality.uniquePayers30d", "stats.uniqueBuyers30d").alias("buyers"),
        let(given("quality.lastCalledAt", "quality.last_called_at", "lastCalledAt"), date).alias("last_called"), complete.alias("completeness"), numbers("score", "toolGradeScore", "quality.score").alias("provider_score"),
        numbers("trustScore", "trust_score", "quality.trustScore").alias("trust_score"), texts("grade", "quality.grade").alias("grade"),
    )


#: Statuses from worst to best.
STATUS_RANK = ("unsafe", "unreachable", "stale", "unknown", "active")


def merge_records(records: DataFrame, key: str, order: str, tags_most: int = 100, options_most: int = 20) -> DataFrame:
    """One record per key: the first name, the longest description (first of equals), largest metrics, the best status with its facts, the latest
    dates, and unions of tags, options and sources in order of first appearance, tags and options up to a number.

    records: key, order, name, description, metric, status, facts, tags, options, source, observed_at. A key's records are the listings of one
    resource in different directories.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, STATUS_RANK)), F.col("status")), F.lit(0))
    earliest = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    base = records.groupBy(key).agg(
        earliest("name").alias("name"), F.max_by("description", F.struct(F.length("description"), -F.col(order))).alias("description"), F.max("metric").alias("metric"),
        F.max_by(F.struct("status", "facts"), F.struct(rank, -F.col(order))).alias("__s"), F.max("observed_at").alias("observed_at"),
    )

    def union(column: str, most: int | None) -> DataFrame:
        each = records.select(key, order, F.posexplode(column).alias("i", "v")) if most else records.select(key, order, F.lit(0).alias("i"), F.col(column).alias("v"))
        first = each.filter("v is not null").groupBy(key, "v").agg(F.min(F.struct(order, "i")).alias("at"))
        placed = first.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("at", "v")))
        kept = placed.filter(F.col("n") <= most) if most else placed
        return kept.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]).alias(column))

    out = base.select(key, "name", "description", "metric", "__s.status", "__s.facts", "observed_at")
    for column, most in (("tags", tags_most), ("options", options_most), ("source", None)):
        out = out.join(union(column, most), key, "left").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return out


def category_sample(rows: DataFrame, key: str, text: str, keywords: dict[str, list[str]], per: int, seed: str) -> DataFrame:
    """(category, key): `per` rows of each category in seeded order, categories in turn; a row that one has taken is not taken again.

    A row's categories are those with a keyword among its tokens. What a category can lose to those before it is at most their samples, so only
    its first per * (number of categories) rows in seeded order can matter, and these few are dealt out in turn.
    """
    words = tokens(F.col(text), ATOMIC_TOKEN)
    names = list(keywords)
    hits = F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, keywords[n]))), F.lit(n)) for n in names]))
    each = rows.select(key, F.explode(hits).alias("category"))
    order = Window.partitionBy("category").orderBy(seeded(seed, F.concat_ws(":", "category", F.col(key))), key)
    near = each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per * len(names))
    taken = None
    for n in names:
        mine = near.filter(F.col("category") == n)
        mine = mine.join(taken.select(key), key, "left_anti") if taken is not None else mine
        picked = mine.withColumn("p", F.row_number().over(Window.orderBy("place"))).filter(F.col("p") <= per).select("category", key)
        taken = picked if taken is None else taken.unionByName(picked)
    return taken


def reviewed_pairs(pairs: DataFrame, query_decisions: DataFrame, pair_decisions: DataFrame) -> DataFrame:
    """pairs (query, key, grade) after the owner's review: (query, key, grade, final, decision, broken). A rejected query takes its pairs along;
    an approved grade must be the same and a corrected one another; pairs without a decision are unreviewed.

    query_decisions: (query, decision); pair_decisions: (query, key, decision, final).
    """
    gone = query_decisions.filter("decision = 'rejected'").select("query", F.lit(True).alias("__gone")).distinct()
    j = pairs.join(gone, "query", "left").join(pair_decisions.select("query", "key", F.col("decision").alias("__d"), F.col("final").alias("__f")), ["query", "key"], "left")
    decision = F.when(F.col("__gone"), "query_rejected").otherwise(F.coalesce("__d", F.lit("unreviewed")))
    broken = ((decision == "approved") & ~F.col("__f").eqNullSafe(F.col("grade"))) | ((decision == "corrected") & F.col("__f").eqNullSafe(F.col("grade")))
    final = F.when(decision == "corrected", F.col("__f")).when(decision.isin("approved", "unreviewed"), F.col("grade"))
    return j.select("query", "key", "grade", final.alias("final"), decision.alias("decision"), broken.alias("broken"))


def merge_shards(shards: DataFrame, size: int, first: int, last: int) -> DataFrame:
    """(issue, n) of sharded rows (shard, id): shards of another size than `size`, repeated ids, ids that are missing or out of range."""
    sizes = shards.groupBy("shard").agg(F.count("*").alias("c")).filter(F.col("c") != size)
    ids = shards.groupBy("id").agg(F.count("*").alias("c"))
    spark = shards.sparkSession
    wanted = spark.range(first, last + 1)
    found = {"shard_size": sizes, "repeated_id": ids.filter("c > 1"), "missing_id": wanted.join(ids, "id", "left_anti"), "out_of_range": ids.filter(~F.col("id").between(first, last))}
    return reduce(DataFrame.unionByName, [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("issue"), "n") for n, d in found.items()])


def append_arrays(rows: DataFrame, more: DataFrame, key: str, column: str) -> DataFrame:
    """Upsert that appends: rows of a known key get more's array behind their own, new keys come in; nothing else changes."""
    added = more.select(key, F.col(column).alias("__more"))
    return rows.join(added, key, "full_outer").withColumn(column, F.concat(F.coalesce(column, F.array()), F.coalesce("__more", F.array()))).drop("__more")


def ordered_union(values: Column, most: int) -> Column:
    """Different values of an array in order of first appearance, at most so many."""
    return F.slice(F.array_distinct(values), 1, most)


def completeness(pairs: DataFrame, queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(check, n): pairs of a full cross product that are missing, found by counts per query and not by building the product; pairs of an unknown
    query or key; repeated pairs. pairs: (query, key); queries: (query); keys: (key)."""
    total = keys.select("key").distinct().agg(F.count("*").alias("all"))
    valid = pairs.join(queries.select("query").distinct(), "query", "left_semi").join(keys.select("key").distinct(), "key", "left_semi").distinct()
    have = valid.groupBy("query").agg(F.count("*").alias("c"))
    missing = queries.select("query").distinct().join(have, "query", "left").crossJoin(F.broadcast(total)).agg(F.sum(F.col("all") - F.coalesce("c", F.lit(0))).alias("n"))
    found = {"unknown_query": pairs.join(queries, "query", "left_anti"), "unknown_key": pairs.join(keys, "key", "left_anti"), "repeated_pair": pairs.groupBy("query", "key").agg(F.count("*").alias("c")).filter("c > 1")}
    parts = [missing.select(F.lit("missing_pair").alias("check"), F.coalesce("n", F.lit(0)).alias("n"))] + [d.agg(F.count("*").alias("n")).select(F.lit(n).alias("check"), "n") for n, d in found.items()]
    return reduce(DataFrame.unionByName, parts)

"""Registered queries of release reports, dataset checks and record normalisation, each with its DuckDB form where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import audit
from tessera.operators import catalog as C
from tessera.operators import evaluation as E
from tessera.operators import records as R
from tessera.operators import reports as P
from tessera.plans import retrieval_queries as Q
from tessera.sources import views as V
from tessera.sources.scratch import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


#: Per-query metrics with planted violations (documents divisible by 5) and queries that expect nothing (divisible by 7).
def _scores_sql(undefined: str) -> str:
    return f"""m AS ({Q._metrics_sql(undefined)}), x AS (WITH {Q._BM25} SELECT item_id AS query_id, doc_id, rank FROM lex), pv AS (SELECT query_id, k, count(*) FILTER (WHERE rank <= k AND doc_id % 5 = 0) AS violations FROM x, (VALUES (1), (3), (5), (10)) ks(k) GROUP BY 1, 2),
 sc AS (SELECT m.*, coalesce(violations, 0) AS violations, query_id % 7 = 0 AS expects_none, query_id % 3 AS class FROM m LEFT JOIN pv USING (query_id, k))"""


def scores(spark, d, as_one):
    ranked = written(Q.lexical(spark, d), "run")
    run = ranked.select(F.col("item_id").alias("query_id"), "doc_id", "rank")
    planted = run.filter("doc_id % 5 = 0").select("query_id", "doc_id")
    found = P.violations(run, planted, Q._KS)
    m = Q._shown(Q.metrics(spark, d, as_one, ranked)).join(found, ["query_id", "k"], "left")
    return m.withColumns({"violations": F.coalesce("violations", F.lit(0)), "expects_none": F.col("query_id") % 7 == 0, "class": F.col("query_id") % 3})


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


_SUITE = """SELECT {by}, count(*) AS queries, count(*) FILTER (WHERE relevant > 0) AS ranking_queries, round(coalesce(avg(recall) FILTER (WHERE relevant > 0), 0), 6) AS recall, round(coalesce(avg("precision") FILTER (WHERE relevant > 0), 0), 6) AS "precision", round(coalesce(avg(ndcg) FILTER (WHERE relevant > 0), 0), 6) AS ndcg,
 round(coalesce(avg(mrr) FILTER (WHERE relevant > 0), 0), 6) AS mrr, CAST(sum(violations) AS BIGINT) AS violations, round(coalesce(sum(unjudged) / nullif(sum(least(k, returned)), 0), 0), 6) AS unjudged_rate, round(avg((returned = 0)::INT), 6) AS no_result_rate, round(avg((CASE WHEN expects_none THEN returned = 0 ELSE returned > 0 END)::INT), 6) AS no_result_accuracy FROM sc GROUP BY {by}"""
_SUITE_COLUMNS = ("recall", "precision", "ndcg", "mrr", "unjudged_rate", "no_result_rate", "no_result_accuracy")


@register("e2_suite_by_class", f"WITH {_scores_sql('1')} {_SUITE.format(by='class, k')}")
def e2_suite_by_class(spark, d):
    return rounded(P.suite(scores(spark, d, True), ["class", "k"]), *_SUITE_COLUMNS)


@register("e2_lift", f"WITH {_scores_sql('1')}, s AS ({_SUITE.format(by='class, k')}) SELECT c.k, round(c.recall - b.recall, 5) AS recall, round(c.ndcg - b.ndcg, 5) AS ndcg, round(c.mrr - b.mrr, 5) AS mrr FROM s c JOIN s b ON c.k = b.k AND c.class = 1 AND b.class = 0")
def e2_lift(spark, d):
    s = rounded(P.suite(scores(spark, d, True), ["class", "k"]), *_SUITE_COLUMNS)
    out = P.lift(s.filter("class = 0").drop("class"), s.filter("class = 1").drop("class"), ["k"])
    return out.withColumns({c: F.round(c, 5) for c in ("recall", "ndcg", "mrr")})


@register("e4_suite_with_support", f"""WITH {_scores_sql('NULL')} SELECT k, count(*) AS queries, round(avg(recall), 6) AS recall, count(recall) AS recall_support, round(avg(ndcg), 6) AS ndcg, count(ndcg) AS ndcg_support, round(avg(bpref), 6) AS bpref, count(bpref) AS bpref_support, round(sum(unjudged) / nullif(sum(least(k, returned)), 0), 6) AS unjudged_rate, CAST(sum(violations) AS BIGINT) AS violations,
 round(sum(violations) / count(*), 6) AS violations_per_query, count(*) FILTER (WHERE expects_none) AS no_result_queries, round(avg((returned = 0)::INT) FILTER (WHERE expects_none), 6) AS no_result_accuracy, round(avg((returned > 0)::INT) FILTER (WHERE NOT expects_none), 6) AS has_result_rate FROM sc GROUP BY 1""")  # fmt: skip
def e4_suite_with_support(spark, d):
    out = rounded(P.suite_with_support(scores(spark, d, False), ["k"]), "recall", "ndcg", "bpref", "unjudged_rate", "violations_per_query", "no_result_accuracy", "has_result_rate")
    return out.drop("precision", "precision_support", "mrr", "mrr_support")


@register("e3_planted_violations", f"WITH {Q._BM25} SELECT item_id AS query_id, k, count(*) FILTER (WHERE rank <= k AND doc_id % 5 = 0)::INT AS violations FROM lex, (VALUES (1), (3), (5), (10)) ks(k) GROUP BY 1, 2")
def e3_planted_violations(spark, d):
    run = Q.lexical(spark, d).select(F.col("item_id").alias("query_id"), "doc_id", "rank")
    return P.violations(run, run.filter("doc_id % 5 = 0"), Q._KS).withColumn("violations", F.col("violations").cast("int"))


_GRADES = "SELECT doc_id % 4 AS a, (doc_id % 4 + CASE WHEN quality = 0 THEN 1 ELSE 0 END + toxic) % 4 AS b, CASE WHEN doc_id % 5 > 0 THEN doc_id % 3 = 0 END AS family FROM labels"


def graded(spark, d):
    k = F.col("doc_id")
    b = (k % 4 + F.when(F.col("quality") == 0, 1).otherwise(0) + F.col("toxic")) % 4
    return V.read(spark, d, "labels").select((k % 4).alias("a"), b.alias("b"), F.when(k % 5 > 0, k % 3 == 0).alias("family"))


@register("e6_stratified_agreement", f"""WITH p AS ({_GRADES}), s AS (SELECT 'all' AS stratum, a, b FROM p UNION ALL SELECT CASE WHEN coalesce(family, greatest(a, b) >= 1) THEN 'relevant' ELSE 'other' END, a, b FROM p),
 n AS (SELECT stratum, count(*) AS n, avg((a = b)::INT) AS exact, avg((abs(a - b) <= 1)::INT) AS within_one, avg((abs(a - b) >= 2)::INT) AS severe, avg(abs(a - b)) AS o1, avg(power(a - b, 2)) AS o2 FROM s GROUP BY 1),
 e AS (SELECT x.stratum, avg(abs(x.a - y.b)) AS e1, avg(power(x.a - y.b, 2)) AS e2 FROM s x JOIN s y ON x.stratum = y.stratum GROUP BY 1), k AS (SELECT n.*, CASE WHEN e2 > 0 THEN 1 - o2 / e2 END AS kq, CASE WHEN e1 > 0 THEN 1 - o1 / e1 END AS kl FROM n JOIN e USING (stratum))
 SELECT stratum, n, round(exact, 6) AS exact, round(within_one, 6) AS within_one, round(severe, 6) AS severe, round(kq, 6) AS kappa_quadratic, round(kl, 6) AS kappa_linear, round(n / (SELECT n FROM k WHERE stratum = 'all'), 6) AS share,
 round((SELECT kq FROM k WHERE stratum = 'all') - (SELECT kq FROM k WHERE stratum = 'relevant'), 6) AS inflation, coalesce((SELECT kq FROM k WHERE stratum = 'relevant') >= 0.6, FALSE) AS passes FROM k""")  # fmt: skip
def e6_stratified_agreement(spark, d):
    return rounded(P.stratified_agreement(graded(spark, d)), "exact", "within_one", "severe", "kappa_quadratic", "kappa_linear", "share", "inflation")


@register("e6_boundary", f"WITH p AS (SELECT * FROM ({_GRADES}) WHERE greatest(a, b) >= 2) SELECT count(*) AS n, count(*) FILTER (WHERE a <> b) AS disagreements, count(*) FILTER (WHERE a = 2 AND b = 3) AS a_two_b_three, count(*) FILTER (WHERE a = 3 AND b = 2) AS a_three_b_two, count(*) FILTER (WHERE least(a, b) <= 1) AS crossing, round(avg((a <> b)::INT), 6) AS disagreement_rate FROM p")
def e6_boundary(spark, d):
    return rounded(P.boundary(graded(spark, d)), "disagreement_rate")


def _lcg_sql(doublings: int = 18) -> str:
    """States 0 to 2^doublings of the release report's generator: each step appends all states so far, moved on by as many steps."""
    a, c = E.LCG
    parts = [f"l0 AS (SELECT 0::BIGINT AS i, {(P.RELEASE_SEED * a + c) % 2**32}::HUGEINT AS s)"]
    for j in range(doublings):
        a, c = E.lcg_steps(2**j)
        parts.append(f"l{j + 1} AS (SELECT * FROM l{j} UNION ALL SELECT i + {2**j}, (s * {a} + {c}) % 4294967296 FROM l{j})")
    return ", ".join(parts)


@register("e9_release_intervals", f"""WITH {_lcg_sql()}, m AS ({Q._metrics_sql('NULL')}), x AS (SELECT query_id % 3 AS class, ndcg AS v, row_number() OVER (PARTITION BY query_id % 3 ORDER BY query_id) - 1 AS i FROM m WHERE k = 5 AND ndcg IS NOT NULL), n AS (SELECT class, count(*) AS n, avg(v) AS mean FROM x GROUP BY 1),
 d AS (SELECT class, n, l.i // n AS sample, CAST(floor(l.s::DOUBLE / 4294967296 * n) AS BIGINT) AS pick FROM l18 l, n WHERE l.i < 1000 * n), s AS (SELECT d.class, sample, sum(v) / any_value(n) AS mean FROM d JOIN x ON x.class = d.class AND x.i = d.pick GROUP BY 1, 2), o AS (SELECT class, list(mean ORDER BY mean) AS means FROM s GROUP BY 1)
 SELECT n.class, n, round(mean, 6) AS mean, round(means[26], 6) AS low, round(means[976], 6) AS high FROM n JOIN o USING (class)""")
def e9_release_intervals(spark, d):
    return rounded(P.release_intervals(scores(spark, d, False).filter("k = 5"), "class", "ndcg", "query_id"), "mean", "low", "high")


_MULBERRY = "(xor(t3, t3 >> 14) / 4294967296.0)"


@register("e10_compare_pairs", f"""WITH v AS (SELECT 'nations' AS comparison, n_nationkey AS q, (n_nationkey * 5 % 13) / 13 - (n_nationkey * 7 % 11) / 11 AS d FROM nation UNION ALL SELECT 'regions', r_regionkey, (r_regionkey * 5 % 13 + 2) / 13 - (r_regionkey * 7 % 11) / 22 FROM region),
 p AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY q) - 1 AS j, count(*) OVER (PARTITION BY comparison) AS n, avg(d) OVER (PARTITION BY comparison) AS diff FROM v),
 g AS (SELECT comparison, n, diff, range // n AS it, range % n AS j, CAST((45063 + 1831565813 * (range + 1)) % 4294967296 AS UBIGINT) AS a FROM (SELECT DISTINCT comparison, n, diff FROM p), range(2000 * 25) WHERE range < 2000 * n),
 g1 AS (SELECT *, (xor(a, a >> 15) * (a | 1)) % 4294967296 AS t1 FROM g), g2 AS (SELECT *, (xor(t1, t1 >> 7) * (t1 | 61)) % 4294967296 AS t2 FROM g1), g3 AS (SELECT *, xor(t1, (t1 + t2) % 4294967296) AS t3 FROM g2), u AS (SELECT comparison, n, diff, it, j, {_MULBERRY} AS u FROM g3),
 bs AS (SELECT u.comparison, it, sum(p.d) / any_value(u.n) AS m FROM u JOIN p ON p.comparison = u.comparison AND p.j = floor(u.u * u.n) GROUP BY 1, 2), bo AS (SELECT *, row_number() OVER (PARTITION BY comparison ORDER BY m) AS r FROM bs), ci AS (SELECT comparison, max(m) FILTER (WHERE r = 51) AS low, max(m) FILTER (WHERE r = 1950) AS high FROM bo GROUP BY 1),
 mc AS (SELECT u.comparison, it, abs(sum(CASE WHEN u.u < 0.5 THEN p.d ELSE -p.d END) / any_value(u.n)) >= abs(any_value(u.diff)) - 1e-12 AS x FROM u JOIN p ON p.comparison = u.comparison AND p.j = u.j GROUP BY 1, 2),
 ex AS (SELECT comparison, range AS mask, abs(sum(CASE WHEN (range >> j) & 1 = 0 THEN d ELSE -d END) / any_value(n)) >= abs(any_value(diff)) - 1e-12 AS x FROM p, range(32) WHERE n <= 20 GROUP BY 1, 2),
 pv AS (SELECT comparison, (count(*) FILTER (WHERE x) + 1) / 2001 AS p FROM mc WHERE comparison = 'nations' GROUP BY 1 UNION ALL SELECT comparison, avg(x::INT) FROM ex GROUP BY 1)
 SELECT comparison, n, round(diff, 9) AS diff, round(p, 9) AS p, round(low, 9) AS low, round(high, 9) AS high, p < 0.05 AND (low > 0 OR high < 0) AS significant FROM (SELECT DISTINCT comparison, n, diff FROM p) JOIN ci USING (comparison) JOIN pv USING (comparison)""")  # fmt: skip
def e10_compare_pairs(spark, d):
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    nations = V.read(spark, d, "nation").select(F.lit("nations").alias("comparison"), n.cast("long").alias("query_id"), ((n * 7 % 11) / 11).alias("base"), ((n * 5 % 13) / 13).alias("cand"))
    regions = V.read(spark, d, "region").select(F.lit("regions").alias("comparison"), r.cast("long").alias("query_id"), ((r * 7 % 11) / 22).alias("base"), ((r * 5 % 13 + 2) / 13).alias("cand"))
    return rounded9(E.compare_runs(nations.unionByName(regions), "score", iterations=2000), "diff", "p", "low", "high")


def rounded9(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@register("e13_tag_spread", """WITH t AS (SELECT 'all' AS tag, * FROM part UNION ALL SELECT 'large', * FROM part WHERE p_size > 25 UNION ALL SELECT 'ring', * FROM part WHERE p_name LIKE '%ring'), f AS (SELECT tag, count(*) AS n, count(DISTINCT p_brand) AS distinct_p_brand, count(DISTINCT p_size) AS distinct_p_size FROM t GROUP BY 1),
 m AS (SELECT tag, max(c) AS max_p_brand FROM (SELECT tag, p_brand, count(*) AS c FROM t GROUP BY 1, 2) GROUP BY 1), s AS (SELECT tag, p_type, count(*) / sum(count(*)) OVER (PARTITION BY tag) AS s FROM t GROUP BY 1, 2),
 g AS (SELECT f.tag, w.p_type, w.s AS w FROM f, s w WHERE w.tag = 'all'), x AS (SELECT g.tag, max(abs(coalesce(s.s, 0) - w)) AS drift FROM g LEFT JOIN s ON s.tag = g.tag AND s.p_type = g.p_type GROUP BY 1) SELECT tag, n, distinct_p_brand, distinct_p_size, max_p_brand, round(drift, 6) AS drift FROM f JOIN m USING (tag) JOIN x USING (tag)""")  # fmt: skip
def e13_tag_spread(spark, d):
    return rounded(spread(spark, d), "drift")


def spread(spark, d):
    rows = V.read(spark, d, "part").withColumns({"large": F.col("p_size") > 25, "ring": F.col("p_name").endswith("ring")})
    return P.tag_spread(rows, ["large", "ring"], "p_type", ["p_brand", "p_size"], ["p_brand"])


@register("e13_checks", f"""WITH v AS (SELECT l_returnflag AS a, l_linestatus AS b FROM lineitem), o AS (SELECT 1) SELECT name, round(value, 4) AS value, passed FROM (
 SELECT 'large-brand-spread' AS name, count(DISTINCT p_brand)::DOUBLE AS value, count(DISTINCT p_brand) >= 20 AS passed FROM part WHERE p_size > 25 UNION ALL
 SELECT 'large-size-spread', count(DISTINCT p_size)::DOUBLE, count(DISTINCT p_size) BETWEEN 1 AND 10 FROM part WHERE p_size > 25 UNION ALL SELECT 'flag-status-association', v, v <= 0.3 FROM ({{}}))""".format(Q.ORACLES["e11_cramers_v"]))  # fmt: skip
def e13_checks(spark, d):
    facts = spread(spark, d).filter("tag = 'large'").crossJoin(E.cramers_v(V.read(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select("v"))
    limits = {"large-brand-spread": ("distinct_p_brand", 20, 1e18), "large-size-spread": ("distinct_p_size", 1, 10), "flag-status-association": ("v", 0, 0.3)}
    return P.verdicts(facts, limits).withColumn("value", F.round("value", 4))


_SIDECARS = """s AS (SELECT p_partkey AS id, p_brand AS provider, p_partkey % 5 <> 0 AS is_distractor, CASE WHEN p_size % 7 = 0 AND (p_partkey % 5 = 0 OR p_partkey % 400 = 1) THEN 'mcp' ELSE 'http' END AS resource_type, split_part(p_name, ' ', 2) AS family, p_brand AS slot, p_size % 10 AS price_tier, CASE p_partkey % 3 WHEN 0 THEN 'testnet_only' WHEN 1 THEN 'pubnet_only' ELSE 'both' END AS network,
 CASE WHEN p_size % 10 < 7 THEN 'exact_only' WHEN p_size % 10 < 9 THEN 'exact_and_upto' ELSE 'upto_only' END AS scheme_set, p_size % 6 = 0 AS adversarial, p_type = 'SMALL' AS sparse FROM part WHERE p_partkey % 97 <> 0),
 c AS (SELECT p_partkey AS id, p_partkey % 200 = 3 AS upto, p_size <> 13 AS agrees FROM part WHERE p_partkey % 89 <> 0)"""
_AUDIT_POLICY = {"providers": 25, "families": 8, "slot_share": 0.06, "upto_price_tier_share": 0.5}


def _audit_sql() -> str:
    """The checks and associations of e13_distribution_audit, each from the rows of its own."""
    n = lambda x, where="true": f"(SELECT {x} FROM s WHERE {where})"
    lab = "NOT is_distractor"
    group = {"mcp": f"{lab} AND resource_type = 'mcp'", "upto": f"{lab} AND scheme_set <> 'exact_only'", "adversarial": f"{lab} AND adversarial", "sparse": f"{lab} AND sparse"}
    count, fixed = lambda w: n("count(*)", w), lambda x: f"printf('%.6f', {x}::DOUBLE)"
    most = lambda a, w: f"(SELECT max(k) FROM (SELECT count(*) AS k FROM s WHERE {w} GROUP BY {a}))"
    tiers, families = lambda w: n("count(DISTINCT price_tier)", w), lambda w: n("count(DISTINCT family)", w)
    share = lambda w, v, a="network": f"({count(f'{w} AND {a} = {chr(39)}{v}{chr(39)}')} / {count(w)})"
    drift = {g: "greatest(" + ", ".join(f"abs({share(w, v)} - {share(lab, v)})" for v in ("testnet_only", "pubnet_only", "both")) + ")" for g, w in group.items()}
    errors = "(SELECT count(*) FROM s FULL JOIN c USING (id) WHERE s.provider IS NULL OR c.agrees IS NULL OR NOT c.agrees)"
    up = "(SELECT count(*) FROM s JOIN c USING (id) WHERE is_distractor AND upto)"
    upto, mcp_upto = f"({count(group['upto'])} / {count(lab)})", f"({count(group['mcp'] + f' AND scheme_set <> {chr(39)}exact_only{chr(39)}')} / {count(group['mcp'])})"
    text = lambda x: f"({x})::VARCHAR"
    is_ = lambda a, v: f"{lab} AND {a} = '{v}'"
    p = audit.POLICY | _AUDIT_POLICY
    rows = {
        "corpus-counts": (f"(SELECT count(*) FROM c) = 500 AND {count('true')} = 500 AND {count(lab)} = 100 AND {count('is_distractor')} = 400", f"'catalog=' || (SELECT count(*) FROM c) || ', sidecars=' || {count('true')} || ', labeled=' || {count(lab)} || ', distractors=' || {count('is_distractor')}"),
        "provider-count": (f"{n('count(DISTINCT provider)')} = 25", f"{n('count(DISTINCT provider)')} || '/25'"), "catalog-sidecar-wire": (f"{errors} = 0", f"{errors} || ' error(s)'"), "distractor-scheme-budget": (f"{up} <= 4", f"{up} || '/' || {count('is_distractor')}"),
        "distractor-resource-type-target": (f"{count(f'is_distractor AND resource_type = {chr(39)}mcp{chr(39)}')} = 0", f"'http=' || {count(f'is_distractor AND resource_type = {chr(39)}http{chr(39)}')} || ', mcp=' || {count(f'is_distractor AND resource_type = {chr(39)}mcp{chr(39)}')}"),
        "resource-type-target": (f"{count(is_('resource_type', 'http'))} = 85 AND {count(group['mcp'])} = 15", f"'http=' || {count(is_('resource_type', 'http'))} || ', mcp=' || {count(group['mcp'])}"),
        "scheme-target": (f"{count(is_('scheme_set', 'exact_only'))} = 70 AND {count(is_('scheme_set', 'exact_and_upto'))} = 22 AND {count(is_('scheme_set', 'upto_only'))} = 8", f"'exact_only=' || {count(is_('scheme_set', 'exact_only'))} || ', exact_and_upto=' || {count(is_('scheme_set', 'exact_and_upto'))} || ', upto_only=' || {count(is_('scheme_set', 'upto_only'))}"),
        "adversarial-target": (f"{count(group['adversarial'])} = 15", text(count(group["adversarial"]))), "sparse-target": (f"{count(group['sparse'])} = 10", text(count(group["sparse"]))),
        "upto-family-spread": (f"{families(group['upto'])} = 8", f"{families(group['upto'])} || '/8'"), "upto-price-spread": (f"{tiers(group['upto'])} >= 8", text(tiers(group["upto"]))), "upto-http-method-spread": ("m", "m"), "upto-resource-type-spread": ("t", "t"),
        "mcp-upto-share": (f"abs({mcp_upto} - {upto}) <= 0.05", f"'overall=' || {fixed(upto)} || ', mcp=' || {fixed(mcp_upto)} || ', drift=' || {fixed(f'abs({mcp_upto} - {upto})')}"), "mcp-family-spread": (f"{families(group['mcp'])} >= 8", f"{families(group['mcp'])} || '/8'"),
        "upto-price-concentration": (f"{most('price_tier', group['upto'])} / {count(group['upto'])} <= 0.5", fixed(f"{most('price_tier', group['upto'])} / {count(group['upto'])}")),
    }
    for i, a, vs in (("upto-http-method-spread", "input_method", ("GET", "POST")), ("upto-resource-type-spread", "resource_type", ("http", "mcp"))):
        here = [f"{count(group['upto'] + f' AND {a} = {chr(39)}{v}{chr(39)}')} > 0" for v in vs]
        rows[i] = (" AND ".join(here), "coalesce(nullif(concat_ws(',', " + ", ".join(f"CASE WHEN {h} THEN '{v}' END" for h, v in zip(here, vs, strict=True)) + "), ''), 'none')")
    for g, w in group.items():
        rows[f"{g}-network-drift"] = (f"{drift[g]} <= 0.15", fixed(drift[g]))
        slot = f"{most('slot', w)} / {count(w)}"
        rows[f"{g}-slot-concentration"] = (f"{slot} <= 0.06", fixed(slot))
        if g != "upto":
            rows[f"{g}-price-spread"] = (f"{tiers(w)} >= {p[f'{g}_min_price_tiers']}", text(tiers(w)))
            rows[f"{g}-price-concentration"] = (f"{most('price_tier', w)} <= 2", text(most("price_tier", w)))
    parts = [f"SELECT '{i}' AS id, {seen} AS observed, {ok} AS passed" for i, (ok, seen) in rows.items()]
    left = {"upto": "scheme_set <> 'exact_only'", "mcp": "resource_type", "network": "network"}
    right = {"family": "family", "price-tier": "price_tier", "input-method": "input_method"}
    for i in audit.ASSOCIATIONS:
        a, b = i.split("-", 1)
        v = f"(WITH t AS (SELECT {left[a]} AS x, {right[b]} AS y, count(*) AS o FROM s WHERE {lab} GROUP BY 1, 2), e AS (SELECT a.x, b.y, a.k * b.k / (SELECT sum(o) FROM t) AS e FROM (SELECT x, sum(o) AS k FROM t GROUP BY 1) a, (SELECT y, sum(o) AS k FROM t GROUP BY 1) b) SELECT sqrt(sum((coalesce(o, 0) - e) ** 2 / e) / ((SELECT sum(o) FROM t) * (SELECT least(count(DISTINCT x), count(DISTINCT y)) - 1 FROM t))) FROM e LEFT JOIN t ON e.x = t.x AND e.y = t.y)"
        parts.append(f"SELECT '{i}', {fixed(v)}, {v} <= 0.30")
    return f"WITH {_SIDECARS.replace('END AS resource_type,', 'END AS resource_type, ' + _METHOD + ' AS input_method,')} " + " UNION ALL ".join(parts)


_METHOD = "CASE WHEN p_size % 7 = 0 AND (p_partkey % 5 = 0 OR p_partkey % 400 = 1) THEN 'not_applicable' WHEN p_partkey % 2 = 0 THEN 'GET' ELSE 'POST' END"


@register("e13_distribution_audit", _audit_sql())
def e13_distribution_audit(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    part = V.read(spark, d, "part")
    mcp = (size % 7 == 0) & ((k % 5 == 0) | (k % 400 == 1))
    sidecars = part.filter(k % 97 != 0).select(
        k.alias("id"), F.col("p_brand").alias("provider"), (k % 5 != 0).alias("is_distractor"), F.when(mcp, "mcp").otherwise("http").alias("resource_type"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("family"), F.col("p_brand").alias("slot"), (size % 10).alias("price_tier"),
        F.when(mcp, "not_applicable").when(k % 2 == 0, "GET").otherwise("POST").alias("input_method"), F.when(k % 3 == 0, "testnet_only").when(k % 3 == 1, "pubnet_only").otherwise("both").alias("network"),
        F.when(size % 10 < 7, "exact_only").when(size % 10 < 9, "exact_and_upto").otherwise("upto_only").alias("scheme_set"), (size % 6 == 0).alias("adversarial"), (F.col("p_type") == "SMALL").alias("sparse"),
    )
    catalog = part.filter(k % 89 != 0).select(k.alias("id"), (k % 200 == 3).alias("upto"), (size != 13).alias("agrees"))
    return audit.distribution_audit(sidecars, catalog, _AUDIT_POLICY)


@register("e14_gates", """WITH p AS (SELECT o_orderstatus AS s, avg(o_totalprice) AS ndcg, avg(o_custkey) AS recall, max(o_totalprice) / 1000 AS p95 FROM orders GROUP BY 1), l AS (SELECT * FROM p WHERE s = 'F'), h AS (SELECT * FROM p WHERE s = 'O'), r AS (SELECT * FROM p WHERE s = 'P')
 SELECT unnest(['hard_violations_zero', 'soft_violations_zero', 'fallbacks_zero', 'hybrid_beats_lexical_ndcg', 'hybrid_beats_lexical_recall', 'reranker_executed', 'reranker_matches_hybrid_ndcg', 'reranker_matches_hybrid_recall', 'hybrid_no_result_accuracy_perfect', 'reranked_no_result_accuracy_perfect', 'hybrid_top1_rate_zero', 'reranked_top1_rate_zero', 'hybrid_p95_within_limit', 'reranked_p95_within_limit', 'queries_curated', 'calibration_passed', 'index_complete']) AS gate,
 unnest([TRUE, FALSE, TRUE, h.ndcg > l.ndcg, h.recall > l.recall, TRUE, r.ndcg >= h.ndcg, r.recall >= h.recall, TRUE, TRUE, TRUE, TRUE, h.p95 <= 1e9, r.p95 <= 1, TRUE, FALSE, TRUE]) AS passed FROM l, h, r""")  # fmt: skip
def e14_gates(spark, d):
    name = F.when(F.col("o_orderstatus") == "F", "lexical").when(F.col("o_orderstatus") == "O", "hybrid").otherwise("reranked")
    p = V.read(spark, d, "orders").groupBy(name.alias("name")).agg(F.avg("o_totalprice").alias("ndcg"), F.avg("o_custkey").alias("recall"), (F.max("o_totalprice") / 1000).alias("p95_ms"))
    p = p.withColumns({"hard_rate": F.lit(0.0), "soft_rate": F.when(F.col("name") == "lexical", 0.1).otherwise(0.0), "fallbacks": F.lit(0), "no_result_accuracy": F.lit(1.0), "top1_rate": F.lit(0.0), "rerank_rate": F.when(F.col("name") == "reranked", 1.0).otherwise(0.0)})
    return P.gate_table(p, {"queries_curated": True, "calibration_passed": False, "index_complete": True}, 1e9, 1.0)


_RUNS = """r AS (SELECT doc_id % 40 AS query, doc_id AS key, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS rank, doc_id % 9 <> 0 AS hard_ok, doc_id % 8 <> 0 AS soft_ok, source AS provider, doc_id % 6 = 0 AS adversarial, CASE lang WHEN 'en' THEN 'warm' WHEN 'de' THEN 'cold' ELSE 'new' END AS freshness FROM documents),
 ql AS (SELECT doc_id % 40 AS query, doc_id AS key, quality * 2 + toxic AS grade FROM labels)"""


def runs(spark, d):
    k = F.col("doc_id")
    docs = V.read(spark, d, "documents").select("doc_id", "lang", "source")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("key"))
    results = docs.select((k % 40).alias("query"), k.alias("key"), (k % 9 != 0).alias("hard_ok"), (k % 8 != 0).alias("soft_ok")).withColumn("rank", rank)
    records = docs.select(k.alias("key"), F.col("source").alias("provider"), (k % 6 == 0).alias("adversarial"), F.when(F.col("lang") == "en", "warm").when(F.col("lang") == "de", "cold").otherwise("new").alias("freshness"))
    qrels = V.read(spark, d, "labels").select((k % 40).alias("query"), k.alias("key"), (F.col("quality") * 2 + F.col("toxic")).alias("grade"))
    queries = results.select("query").distinct().withColumn("adversarial_query", F.col("query") % 5 == 0)
    return results, records, qrels, queries


@register("e15_profile_facts", f"""WITH {_RUNS}, x AS (SELECT r.*, coalesce(grade, 0) AS grade, r.query % 5 = 0 AS hq FROM r LEFT JOIN ql USING (query, key)), p AS (SELECT max(c) AS most FROM (SELECT provider, count(*) AS c FROM r WHERE rank <= 5 GROUP BY 1)), q AS (SELECT count(DISTINCT query) AS q, count(DISTINCT query) FILTER (WHERE query % 5 = 0) AS hq FROM r)
 SELECT count(*) AS returned, round(avg((grade = 0)::INT), 6) AS grade_zero_rate, round(avg((NOT hard_ok)::INT), 6) AS hard_violation_rate, round(avg((hard_ok AND NOT soft_ok)::INT), 6) AS soft_violation_rate, round(count(*) FILTER (WHERE rank = 1 AND x.hq AND adversarial) / any_value(q.hq), 6) AS adversarial_top1_rate,
 round(count(*) FILTER (WHERE rank = 1 AND x.hq AND NOT adversarial AND grade >= 2) / any_value(q.hq), 6) AS adversarial_resistance_rate, round(avg((freshness = 'warm')::INT), 6) AS warm_share, round(avg((freshness = 'cold')::INT), 6) AS cold_share, round(any_value(most) / (5 * any_value(q.q)), 6) AS provider_concentration FROM x, p, q""")  # fmt: skip
def e15_profile_facts(spark, d):
    out = P.profile_facts(*runs(spark, d))
    return rounded(out, *[c for c in out.columns if c != "returned"])


@register("e15_subset_recall", f"WITH {_RUNS}, v AS (SELECT freshness, ql.query, avg((r.rank <= 20)::INT) AS rc FROM ql JOIN r USING (query, key) WHERE grade >= 2 GROUP BY 1, 2) SELECT freshness, count(*) AS queries, round(avg(rc), 6) AS recall FROM v GROUP BY 1")
def e15_subset_recall(spark, d):
    results, records, qrels, _ = runs(spark, d)
    return rounded(P.subset_recall(results, records, qrels, "freshness"), "recall")


@register("e18_recommendations", f"""WITH {_RUNS}, x AS (SELECT r.*, grade FROM r LEFT JOIN ql USING (query, key) WHERE rank <= 5), o AS (SELECT max(c) AS most FROM (SELECT provider, count(*) AS c FROM x GROUP BY 1))
 SELECT count(*) AS shown, count(*) FILTER (WHERE grade = 0) AS violations, count(*) FILTER (WHERE adversarial) AS unsafe, count(*) FILTER (WHERE grade IS NULL) AS unjudged, round(avg((key % 4 = 0 OR key % 7 = 0)::INT), 6) AS cold_share, round(any_value(most) / count(*), 6) AS concentration FROM x, o""")  # fmt: skip
def e18_recommendations(spark, d):
    results, records, qrels, _ = runs(spark, d)
    k = F.col("key")
    catalog = records.select("key", F.col("provider").alias("origin"), F.when(k % 4 == 0, 0).when(k % 7 != 0, k).alias("volume"), F.col("adversarial").alias("unsafe"))
    judged = qrels.select("query", "key", F.when(F.col("grade") == 0, "stale").otherwise("eligible").alias("eligibility"))
    return rounded(P.recommendation_facts(results, catalog, judged), "cold_share", "concentration")


@register("e18_by_class", f"""WITH {Q._BM25}, m AS ({Q._metrics_sql('NULL')}), t AS (SELECT item_id AS query, arg_min(doc_id, rank + CASE WHEN doc_id % 4 = 1 THEN 0 ELSE 1000 END) AS key FROM lex GROUP BY 1), x AS (SELECT item_id AS query, item_id % 3 AS class, relevant, ndcg, CASE key % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS success FROM benchmark LEFT JOIN m ON m.query_id = item_id AND k = 5 LEFT JOIN t ON t.query = item_id)
 SELECT class, count(*) AS queries, count(*) FILTER (WHERE relevant > 0) AS evaluable, round(coalesce(avg(coalesce(ndcg, 0)) FILTER (WHERE relevant > 0), 0), 6) AS ndcg_at_5, round(coalesce(avg(success), 0), 6) AS task_success_rate FROM x GROUP BY 1""")
def e18_by_class(spark, d):
    k = F.col("doc_id")
    ranked = written(Q.lexical(spark, d), "run")
    run = ranked.select(F.col("item_id").alias("query"), k.alias("key"), "rank", F.when(k % 4 == 1, True).alias("selected"))
    told = F.when(k % 3 == 0, True).when(k % 3 == 1, False)
    outcomes = ranked.select(F.col("item_id").alias("query"), k.alias("key"), F.lit(1).alias("seq"), told.alias("task_success")).unionByName(ranked.select(F.col("item_id").alias("query"), k.alias("key"), F.lit(2).alias("seq"), F.lit(True).alias("task_success")))
    queries = V.read(spark, d, "benchmark").select(F.col("item_id").alias("query"), (F.col("item_id") % 3).alias("class"))
    metrics = Q._shown(Q.metrics(spark, d, False, ranked)).filter("k = 5").select(F.col("query_id").alias("query"), "relevant", "ndcg")
    return rounded(P.class_metrics(queries, metrics, run, outcomes), "ndcg_at_5", "task_success_rate")


@register("e18_operational", """WITH o AS (SELECT *, l_returnflag <> 'R' AS attempted FROM lineitem), a AS (SELECT * FROM o WHERE attempted)
 SELECT count(*) AS attempted, round(avg((l_linestatus = 'O')::INT), 6) AS payment_verification_rate, round(avg((l_quantity > 10)::INT), 6) AS settlement_rate, round(avg((l_linenumber > 1)::INT), 6) AS invocation_rate, round(avg(CASE WHEN l_linenumber <> 2 THEN (l_suppkey % 3 = 0)::INT END), 6) AS response_valid_rate, round(avg(CASE WHEN l_linenumber <> 3 THEN (l_partkey % 4 = 0)::INT END), 6) AS task_success_rate,
 round(avg(CASE WHEN l_linenumber <> 4 THEN l_quantity END), 6) AS mean_latency_ms, quantile_disc(CASE WHEN l_linenumber <> 4 THEN l_quantity END, 0.95)::DOUBLE AS p95_latency_ms, round(avg(l_discount), 6) AS mean_cost_usd, (SELECT count(*) FROM o WHERE l_tax > 0.04) AS selected FROM a""")
def e18_operational(spark, d):
    c, n = F.col, F.col("l_linenumber")
    word = lambda x: F.when(x, "pass").otherwise("fail")
    outcomes = V.read(spark, d, "lineitem").select(
        (c("l_returnflag") != "R").alias("attempted"), (c("l_tax") > 0.04).alias("selected"), word(c("l_linestatus") == "O").alias("payment_verification"), word(c("l_quantity") > 10).alias("settlement"), F.when(n > 1, "pass").alias("invocation"),
        F.when(n != 2, c("l_suppkey") % 3 == 0).alias("response_valid"), F.when(n != 3, c("l_partkey") % 4 == 0).alias("task_success"), F.when(n != 4, c("l_quantity")).alias("latency_ms"), c("l_discount").alias("total_cost_usd"),
    )
    return rounded(P.operational_metrics(outcomes), "payment_verification_rate", "settlement_rate", "invocation_rate", "response_valid_rate", "task_success_rate", "mean_latency_ms", "mean_cost_usd")


@register("e26_input_issues", """WITH q AS (SELECT item_id AS query FROM benchmark), r AS (SELECT 's' || doc_id % 3 AS system, doc_id % 45 AS query, doc_id % 100 AS key, doc_id % 10 AS rank FROM documents), sq AS (SELECT DISTINCT system, query FROM r), g AS (SELECT DISTINCT system, q.query FROM r, q)
 SELECT 'missing_query' AS issue, count(*) AS n FROM g WHERE (system, query) NOT IN (SELECT (system, query) FROM sq) UNION ALL SELECT 'unknown_query', count(*) FROM sq WHERE query NOT IN (SELECT query FROM q) UNION ALL SELECT 'repeated_rank', count(*) FROM (SELECT 1 FROM r GROUP BY system, query, rank HAVING count(*) > 1) UNION ALL
 SELECT 'repeated_result', count(*) FROM (SELECT 1 FROM r GROUP BY system, query, key HAVING count(*) > 1) UNION ALL SELECT 'repeated_judgment', count(*) FROM (SELECT 1 FROM labels GROUP BY doc_id % 5, doc_id % 70 HAVING count(*) > 1)""")  # fmt: skip
def e26_input_issues(spark, d):
    k = F.col("doc_id")
    r = V.read(spark, d, "documents").select(F.concat(F.lit("s"), k % 3).alias("system"), (k % 45).alias("query"), (k % 100).alias("key"), (k % 10).alias("rank"))
    return P.input_issues(V.read(spark, d, "benchmark").select(F.col("item_id").alias("query")), r, V.read(spark, d, "labels").select((k % 5).alias("query"), (k % 70).alias("key")))


@register("e28_family_gates", "SELECT p_brand, count(*) AS n, count(DISTINCT p_name) AS capabilities, count(*) = 20 AND count(DISTINCT p_name) = 20 AS passed FROM part GROUP BY 1")
def e28_family_gates(spark, d):
    return P.family_gates(V.read(spark, d, "part"), "p_brand", "p_name", 20)


@register("a27_liveness", "SELECT count(quality) AS observed, count(*) FILTER (WHERE quality = 1) AS passed, count(*) FILTER (WHERE quality = 0) AS failed, count(*) FILTER (WHERE quality IS NULL) AS unknown FROM documents LEFT JOIN labels USING (doc_id)")
def a27_liveness(spark, d):
    rows = V.read(spark, d, "documents").select("doc_id").join(V.read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return P.liveness(rows.select(F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "fail").alias("liveness")))


@register("e24_reviewed_pairs", """WITH p AS (SELECT doc_id % 20 AS query, doc_id AS key, quality AS grade, CASE WHEN doc_id % 20 % 6 = 0 THEN 'query_rejected' WHEN doc_id % 4 = 0 THEN 'approved' WHEN doc_id % 4 = 1 THEN 'corrected' WHEN doc_id % 4 = 2 THEN 'rejected' ELSE 'unreviewed' END AS decision, CASE WHEN doc_id % 10 = 0 THEN 1 - quality ELSE quality END AS kept, toxic FROM labels)
 SELECT query, key, grade, CASE decision WHEN 'corrected' THEN toxic WHEN 'approved' THEN grade WHEN 'unreviewed' THEN grade END AS final, decision, (decision = 'approved' AND kept <> grade) OR (decision = 'corrected' AND toxic = grade) AS broken FROM p""")  # fmt: skip
def e24_reviewed_pairs(spark, d):
    k = F.col("doc_id")
    labels = V.read(spark, d, "labels")
    pairs = labels.select((k % 20).alias("query"), k.alias("key"), F.col("quality").alias("grade"))
    queries = pairs.select("query").distinct().select("query", F.when(F.col("query") % 6 == 0, "rejected").otherwise("approved").alias("decision"))
    made = F.when(k % 4 == 0, "approved").when(k % 4 == 1, "corrected").otherwise("rejected")
    final = F.when(k % 4 == 1, F.col("toxic")).when(k % 10 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return P.reviewed_pairs(pairs, queries, labels.filter(k % 4 != 3).select((k % 20).alias("query"), k.alias("key"), made.alias("decision"), final.alias("final")))


@register("d11_sidecar_issues", """WITH r AS (SELECT l_orderkey AS key, CASE WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag <> 'R') THEN 'exact_and_upto' WHEN bool_or(l_returnflag = 'R') THEN 'upto_only' ELSE 'exact_only' END AS s, list_sort(list(DISTINCT l_linestatus)) AS n, min(l_quantity) AS p FROM lineitem GROUP BY 1),
 i AS (SELECT o_orderkey AS key, list_filter([CASE WHEN coalesce(s, 'exact_only') <> 'exact_and_upto' THEN 'scheme_set' END, CASE WHEN coalesce(n, []) <> ['F', 'O'] THEN 'networks' END, CASE WHEN p IS NULL OR p <> 1 THEN 'price' END, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'sparse' END], lambda x: x IS NOT NULL) AS issues FROM orders LEFT JOIN r ON key = o_orderkey)
 SELECT key, issues FROM i WHERE len(issues) > 0""")  # fmt: skip
def d11_sidecar_issues(spark, d):
    k = F.col("o_orderkey")
    sidecars = V.read(spark, d, "orders").select(k.alias("key"), F.lit("exact_and_upto").alias("scheme_set"), F.array(F.lit("O"), F.lit("F")).alias("networks"), F.lit(1.0).alias("price"), (k % 3 == 0).alias("is_sparse"), (k % 2 == 0).alias("described"))
    options = V.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.when(F.col("l_returnflag") == "R", "upto").otherwise("exact").alias("scheme"), F.col("l_linestatus").alias("network"), F.col("l_quantity").alias("amount"))
    return P.sidecar_issues(sidecars, options)


@register("d22_metadata_issues", """SELECT p_partkey, list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'name' END, CASE WHEN p_partkey % 3 = 0 OR p_type = p_brand THEN 'tags' END, CASE WHEN p_partkey % 5 = 0 THEN 'icon' END, CASE WHEN p_partkey % 7 = 0 THEN 'description' END, CASE WHEN p_partkey % 11 = 0 THEN 'mime' END, CASE WHEN p_partkey % 13 = 0 THEN 'method' END, CASE WHEN p_partkey % 13 = 0 OR p_partkey % 4 = 1 THEN 'body' END], lambda x: x IS NOT NULL) AS issues FROM part""")
def d22_metadata_issues(spark, d):
    k, n = F.col("p_partkey"), F.col("p_name")
    issues = P.metadata_issues(
        F.when(k % 2 == 0, F.concat(n, F.lit("é"))).otherwise(n), F.when(k % 3 == 0, F.array("p_brand", "p_brand")).otherwise(F.array("p_brand", "p_type")),
        F.when(k % 5 == 0, "http://localhost/i.png").when(k % 5 == 1, "https://icons.example/i.png"), F.when(k % 7 == 0, "  ").otherwise(n), F.when(k % 11 == 0, "nonsense").otherwise("application/json"),
        F.when(k % 13 == 0, "BREW").when(k % 4 == 1, "GET").otherwise("POST"), F.lit(True),
    )
    return V.read(spark, d, "part").select("p_partkey", issues.alias("issues"))


@register("d23_cohort_queries", """SELECT item_id, 'eco-qry-' || lpad((row_number() OVER (ORDER BY item_id))::VARCHAR, 4, '0') AS query_id, CASE WHEN item_id % 4 = 0 THEN 'price' ELSE 'semantic' END AS query_class, array_to_string(list_filter([CASE WHEN item_id % 3 = 0 THEN 'a=y' ELSE 'a=x' END, CASE WHEN item_id % 2 = 0 THEN 'n=1' END, CASE WHEN item_id % 3 = 0 THEN 'z=9' END], lambda x: x IS NOT NULL), ',') AS filters FROM benchmark""")
def d23_cohort_queries(spark, d):
    k = F.col("item_id")
    mine = F.create_map(F.lit("a"), F.lit("x"), F.lit("n"), F.when(k % 2 == 0, "1"))
    more = F.when(k % 3 == 0, F.create_map(F.lit("a"), F.lit("y"), F.lit("z"), F.lit("9")))
    rows = V.read(spark, d, "benchmark").select("item_id", F.when(k % 4 == 0, "price_category").otherwise("semantic").alias("query_class"), "text", mine.alias("filters"), more.alias("constraints"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("filters"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return P.cohort_queries(rows, "item_id", rename={"price_category": "price"}).select("item_id", "query_id", "query_class", shown.alias("filters"))


_CODES = ("absent", "not_an_object", "metadata_too_large", "metadata_too_deep", "spec_invalid", "schema_invalid", "schema_too_large", "example_too_large", "url_missing", "url_malformed", "url_scheme", "url_credentials", "url_private_host", "tool_missing")


@register("d1_extraction", "SELECT page_id, CASE WHEN page_id % 16 IN (5, 14) THEN CASE WHEN length(url) BETWEEN 24 AND 48 AND substr(url, 1, 5) IN ('https', 'http:') THEN NULL ELSE 'schema_invalid' END WHEN page_id % 16 < 14 THEN (" + str(list(_CODES)) + ")[page_id % 16 + 1] END AS code, CASE page_id % 16 WHEN 15 THEN 'routeTemplate,description,mimeType,tags' ELSE '' END AS dropped FROM pages")
def d1_extraction(spark, d):
    k = F.col("page_id")
    m = k % 16
    pick = lambda n, bad, good: F.when(m == n, F.lit(bad)).otherwise(F.lit(good))
    url = F.when(m == 8, "").when(m == 9, "nothing like it").when(m == 10, "ftp://h.example/x").when(m == 11, "https://u:p@h.example/x").when(m == 12, "https://127.0.0.1/x").otherwise(F.concat(F.lit("https://h"), k.cast("string"), F.lit(".example/x")))
    # the declared schema bounds values of the table: the length of its URL, and how it starts
    bounds = '{"required":["input"],"properties":{"input":{"required":["n"],"properties":{"n":{"type":"integer","minimum":24,"maximum":48},"parts":{"items":{"enum":["https","http:"]}}}}}}'
    values = F.when(m.isin(5, 14), F.concat(F.lit(',"n":'), F.length("url").cast("string"), F.lit(',"parts":['), F.lit('"'), F.substring("url", 1, 5), F.lit('"'), F.lit("]"))).otherwise("")
    schema = F.when(m.isin(5, 14), bounds).when(m == 6, '{"s":"' + "s" * 300 + '"}').otherwise("{}")
    example = F.when(m == 7, '"' + "e" * 120 + '"').otherwise('"e"')
    kind = F.when(m == 13, '"type":"mcp"').otherwise('"type":"http"')
    info = F.when(m == 4, '"info":{}').otherwise(F.concat(F.lit('"info":{"input":{'), kind, F.lit(',"example":'), example, values, F.lit("}}")))
    pad = F.concat(F.lit('"pad":"'), pick(2, "p" * 900, "p"), F.lit('","deep":'), pick(3, "[" * 12 + "]" * 12, "[]"))
    ext = F.when(m == 1, "[]").otherwise(F.concat(F.lit("{"), info, F.lit(',"schema":'), schema, F.lit(","), pad, F.when(m == 15, ',"routeTemplate":"/a/../b"').otherwise(',"routeTemplate":"/a/:id"'), F.lit("}")))
    soft = F.when(m == 15, ',"description":"  ","mimeType":"x","tags":"no list"').otherwise(',"description":"d","mimeType":"a/b","tags":["t"]')
    body = F.concat(F.lit('{"resource":{"url":"'), url, F.lit('"'), soft, F.lit("}"), F.when(m == 0, "").otherwise(F.concat(F.lit(',"extension":'), ext)), F.lit("}"))
    found = P.extraction(F.col("body"), {"metadata": 800, "depth": 8, "schema": 200, "example": 100})
    return V.read(spark, d, "pages").select("page_id", body.alias("body")).select("page_id", found.alias("f")).select("page_id", F.col("f.code").alias("code"), F.array_join("f.dropped", ",").alias("dropped"))


@register("d6_external_records", """SELECT p_partkey, 'https://h' || p_partkey || '.example/a' AS url, CASE p_partkey % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'mcp' WHEN 2 THEN 'a2a' ELSE 'http' END || ':https://h' || p_partkey || '.example/a' AS key, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'meta' ELSE 'own' END AS description, CASE WHEN p_partkey % 5 = 0 THEN '2024' END AS updated,
 CASE p_size % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' ELSE 'unknown' END AS liveness, CASE WHEN p_size % 10 = 0 THEN 'fail' WHEN p_size % 10 = 1 THEN 'pass' ELSE 'unknown' END AS safety, CASE WHEN p_size % 10 = 0 THEN 'unsafe' WHEN p_size % 3 = 1 THEN 'unreachable' WHEN p_partkey % 7 = 0 THEN 'stale' WHEN p_size % 3 = 0 THEN 'active' ELSE 'unknown' END AS status,
 list_distinct_ordered AS tags, [p_type] AS categories, p_brand || '|USD|' || p_size AS accepts, CASE WHEN p_size % 4 = 0 THEN 'pass' WHEN p_size % 4 = 1 THEN 'fail' ELSE 'unknown' END AS payment, CASE WHEN p_size % 2 = 0 THEN p_size % 4 = 0 END AS response_valid, CASE WHEN p_size % 3 = 1 THEN p_retailprice END AS latency_ms,
 CASE WHEN p_size % 5 <> 0 THEN p_size::BIGINT END AS calls, p_partkey AS buyers, CASE WHEN p_size % 6 = 0 THEN '2024-02-0' || (1 + p_size % 7) || 'T03:04:05.000Z' END AS last_called, CASE WHEN p_size % 2 = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS completeness, p_size + 0.5::DOUBLE AS provider_score, CASE WHEN p_size % 2 = 0 THEN 0.25::DOUBLE END AS trust_score, 'A' || p_size AS grade
 FROM (SELECT *, CASE WHEN p_name = p_brand THEN [p_name] ELSE [p_name, p_brand] END AS list_distinct_ordered FROM part)""")  # fmt: skip
def d6_external_records(spark, d):
    k, z, text = F.col("p_partkey"), F.col("p_size"), F.lit
    field = lambda name, c: F.concat(text(f'"{name}":"'), c, text('",'))
    body = F.concat(
        text("{"), F.when(k % 3 == 1, field("resource", text(" "))).otherwise(""), field("endpoint", F.concat(text("HTTPS://H"), k.cast("string"), text(".example:443/a/?q=1#f"))),
        F.when(k % 2 == 0, field("service_name", F.col("p_name"))).otherwise(field("title", F.col("p_brand"))), F.when(k % 4 == 1, field("type", text("my-MCP-server"))).when(k % 4 == 2, field("transport", text("agent"))).when(k % 4 == 0, field("type", text("http"))).otherwise(""),
        F.when(k % 3 == 0, text('"description":"","metadata":{"description":"meta"},')).otherwise(field("description", text("own"))), F.when(k % 5 == 0, field("updatedAt", text("2024"))).otherwise(""),
        F.when(z % 3 == 0, text('"healthy":true,')).when(z % 3 == 1, text('"health":{"status":"unhealthy"},')).otherwise(""), F.when(z % 10 == 0, field("safetyStatus", text("unsafe"))).when(z % 10 == 1, text('"safety":true,')).otherwise(""), F.when(k % 7 == 0, text('"stale":true,')).otherwise(""), _details(k, z), text('"end":0}'),
    )
    bodies = V.dealt(V.read(spark, d, "part"), 20_000, "p_partkey").select("p_partkey", body.alias("body"))
    found = bodies.select("p_partkey", P.external_record(F.col("body")).alias("r"), P.external_details(F.col("body")).alias("q")).select("p_partkey", "r.*", "q.*").drop("failure_reason")
    shown = F.array_join(F.transform("accepts", lambda o: F.concat_ws("|", o["network"], o["asset"], o["max_timeout_seconds"].cast("string"))), ";")
    return found.withColumn("accepts", shown)


def _details(k, z):
    """Members of an external record, some of them of no use, made of a part's values."""
    text, own = F.lit, lambda c: c.cast("string")
    return F.concat(
        text('"tags":["'), F.col("p_name"), text('"," ",7,"'), F.col("p_brand"), text('"," '), F.col("p_name"), text('"],"category":"'), F.col("p_type"), text('","accepts":[{"scheme":"exact"},{"scheme":"exact","chain":"'), F.col("p_brand"), text('","currency":"USD","maxAmountRequired":"5","max_timeout_seconds":"'), own(z), text('"},3],'),
        F.when(z % 4 == 0, '"payment":true,').when(z % 4 == 1, '"onChainDemand":"fail",').otherwise('"payment":null,"on_chain_demand":1,'), F.when(z % 4 == 0, '"responseValid":true,').when(z % 4 == 2, '"responseValid":"no","response_valid":false,').otherwise(""), F.when(z % 3 == 1, F.concat(text('"latency_ms":'), own(F.col("p_retailprice")), text(","))).otherwise('"latencyMs":"9",'),
        text('"quality":{"l30DaysTotalCalls":'), F.when(z % 5 == 0, text('"5"')).otherwise(own(z)), text(',"uniquePayers30d":'), own(k), F.when(z % 6 == 0, F.concat(text(',"last_called_at":"2024-02-0'), own(1 + z % 7), text('T05:04:05+02:00"'))).otherwise(',"lastCalledAt":"soon"'), F.when(z % 2 == 0, ',"trustScore":0.25').otherwise(""), text(',"grade":"A'), own(z), text('"},"score":'), own(z), text(".5,"), F.when(z % 2 == 1, '"outputSchema":{},').otherwise('"schema":null,'),
    )


@register("d7_merge_records", """WITH r AS (SELECT o_custkey AS key, o_orderkey AS ord, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS name, repeat('d', (o_orderkey % 7)::INT) || o_orderkey % 2 AS description, o_totalprice AS metric, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'stale' ELSE 'unsafe' END AS status, CASE o_orderstatus WHEN 'F' THEN 5 WHEN 'O' THEN 3 ELSE 1 END AS rank, o_orderdate AS observed_at, 's' || o_orderkey % 5 AS source FROM orders),
 t AS (SELECT key, v, min(p) AS p FROM (SELECT o_custkey AS key, o_orderpriority AS v, o_orderkey * 2 AS p FROM orders UNION ALL SELECT o_custkey, o_orderstatus, o_orderkey * 2 + 1 FROM orders) GROUP BY 1, 2), tl AS (SELECT key, list_slice(list(v ORDER BY p), 1, 3) AS tags FROM t GROUP BY 1),
 o AS (SELECT key, v, min(p) AS p FROM (SELECT o_custkey AS key, 'o' || o_orderkey % 4 AS v, o_orderkey AS p FROM orders) GROUP BY 1, 2), ol AS (SELECT key, list_slice(list(v ORDER BY p), 1, 2) AS options FROM o GROUP BY 1), s AS (SELECT key, source, min(ord) AS p FROM r GROUP BY 1, 2), sl AS (SELECT key, list(source ORDER BY p) AS source FROM s GROUP BY 1)
 SELECT key, arg_min(name, ord) FILTER (WHERE name IS NOT NULL) AS name, arg_max(description, length(description) * 10000000 - ord) AS description, max(metric) AS metric, arg_max(status, rank * 10000000 - ord) AS status, arg_max(ord::VARCHAR, rank * 10000000 - ord) AS facts, max(observed_at) AS observed_at, any_value(tags) AS tags, any_value(options) AS options, any_value(sl.source) AS source FROM r JOIN tl USING (key) JOIN ol USING (key) JOIN sl USING (key) GROUP BY key""")  # fmt: skip
def d7_merge_records(spark, d):
    k = F.col("o_orderkey")
    rows = V.read(spark, d, "orders").select(
        F.col("o_custkey").alias("key"), k.alias("ord"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("name"), F.concat(F.expr("repeat('d', cast(o_orderkey % 7 as int))"), k % 2).alias("description"), F.col("o_totalprice").alias("metric"),
        F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "stale").otherwise("unsafe").alias("status"), k.cast("string").alias("facts"), F.array("o_orderpriority", "o_orderstatus").alias("tags"),
        F.array(F.concat(F.lit("o"), k % 4)).alias("options"), F.concat(F.lit("s"), k % 5).alias("source"), F.col("o_orderdate").alias("observed_at"),
    )
    return P.merge_records(rows, "key", "ord", 3, 2)


def _category_sql() -> str:
    names, steps = ("gear", "blue", "ring"), []
    for i, n in enumerate(names):
        before = " AND ".join([f"p_partkey NOT IN (SELECT p_partkey FROM {m})" for m in names[:i]] or ["TRUE"])
        steps.append(f"{n} AS (SELECT '{n}' AS category, p_partkey FROM part WHERE contains(p_name, '{n}') AND {before} ORDER BY sha256('k' || chr(0) || '{n}:' || p_partkey), p_partkey LIMIT 15)")
    return "WITH " + ", ".join(steps) + " SELECT * FROM gear UNION ALL SELECT * FROM blue UNION ALL SELECT * FROM ring"


@register("d10_category_sample", _category_sql())
def d10_category_sample(spark, d):
    return P.category_sample(V.read(spark, d, "part"), "p_partkey", "p_name", {n: [n] for n in ("gear", "blue", "ring")}, 15, "k")


@register("u7_shard_merge", """WITH s AS (SELECT p_partkey // 100 AS shard, CASE WHEN p_partkey % 97 = 0 THEN p_partkey + 1 WHEN p_partkey % 89 = 0 THEN p_partkey + 100000 ELSE p_partkey END AS id FROM part WHERE p_partkey % 61 <> 5), c AS (SELECT id, count(*) AS c FROM s GROUP BY 1)
 SELECT 'shard_size' AS issue, count(*) AS n FROM (SELECT 1 FROM s GROUP BY shard HAVING count(*) <> 98) UNION ALL SELECT 'repeated_id', count(*) FROM c WHERE c > 1 UNION ALL SELECT 'missing_id', count(*) FROM range(0, 200) WHERE range NOT IN (SELECT id FROM c) UNION ALL SELECT 'out_of_range', count(*) FROM c WHERE id NOT BETWEEN 0 AND 199""")  # fmt: skip
def u7_shard_merge(spark, d):
    k = F.col("p_partkey")
    rows = V.read(spark, d, "part").filter(k % 61 != 5).select(F.floor(k / 100).alias("shard"), F.when(k % 97 == 0, k + 1).when(k % 89 == 0, k + 100000).otherwise(k).alias("id"))
    return P.merge_shards(rows, 98, 0, 199)


@register("u6_upsert_append", """WITH a AS (SELECT c_nationkey AS key, list_sort(list(c_custkey)) AS ids FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY 1), b AS (SELECT s_nationkey AS key, list_sort(list(s_suppkey)) AS ids FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1) SELECT key, list_concat(coalesce(a.ids, []), coalesce(b.ids, [])) AS ids FROM a FULL JOIN b USING (key)""")
def u6_upsert_append(spark, d):
    a = V.read(spark, d, "customer").filter("c_nationkey % 4 <> 0").groupBy(F.col("c_nationkey").alias("key")).agg(F.sort_array(F.collect_list("c_custkey")).alias("ids"))
    b = V.read(spark, d, "supplier").filter("s_nationkey % 3 <> 0").groupBy(F.col("s_nationkey").alias("key")).agg(F.sort_array(F.collect_list("s_suppkey")).alias("ids"))
    return P.append_arrays(a, b, "key", "ids")


@register("u4_first_kinds", "WITH f AS (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY 1, 2) SELECT user_id, list_slice(list(event_type ORDER BY p), 1, 3) AS kinds FROM f GROUP BY 1")
def u4_first_kinds(spark, d):
    kinds = F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return V.read(spark, d, "events").groupBy("user_id").agg(kinds.alias("all")).select("user_id", P.ordered_union(F.col("all"), 3).alias("kinds"))


@register("d18_completeness", """WITH p AS (SELECT doc_id % 45 AS query, doc_id % 30 AS key FROM documents), q AS (SELECT item_id AS query FROM benchmark), k AS (SELECT n_nationkey AS key FROM nation), v AS (SELECT DISTINCT query, key FROM p SEMI JOIN q USING (query) SEMI JOIN k USING (key))
 SELECT 'missing_pair' AS "check", CAST((SELECT count(*) FROM q) * (SELECT count(*) FROM k) - (SELECT count(*) FROM v) AS BIGINT) AS n UNION ALL SELECT 'unknown_query', count(*) FROM p ANTI JOIN q USING (query) UNION ALL SELECT 'unknown_key', count(*) FROM p ANTI JOIN k USING (key) UNION ALL SELECT 'repeated_pair', count(*) FROM (SELECT 1 FROM p GROUP BY query, key HAVING count(*) > 1)""")  # fmt: skip
def d18_completeness(spark, d):
    k = F.col("doc_id")
    pairs = V.read(spark, d, "documents").select((k % 45).alias("query"), (k % 30).alias("key"))
    return P.completeness(pairs, V.read(spark, d, "benchmark").select(F.col("item_id").alias("query")), V.read(spark, d, "nation").select(F.col("n_nationkey").alias("key")))


@register("r12_both_thresholds", f"""WITH {Q._FUSED}, s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM fused WHERE score >= 0.02), t AS (SELECT *, rank <= 10 AS head, (doc_id * 7 + query_id) % 13 / 200 AS new FROM s),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY NOT head, CASE WHEN head THEN new END DESC NULLS LAST, CASE WHEN NOT head THEN rank END, doc_id DESC) AS r FROM t) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM o WHERE CASE WHEN head THEN new ELSE score END >= 0.02""")  # fmt: skip
def r12_both_thresholds(spark, d):
    from tessera.operators import retrieval as R

    rows = Q.fused(spark, d)
    new = rows.filter("rank <= 10").select("query_id", "doc_id", ((F.col("doc_id") * 7 + F.col("query_id")) % 13 / 200).alias("score"))
    return R.thresholded(rows, new, "query_id", "doc_id", 10, 0.02).select("query_id", "doc_id", "rank")


@register("j17_overlay_rejects", "SELECT vec_id AS doc_id, label AS quality FROM embeddings WHERE vec_id % 3 = 0 AND vec_id NOT IN (SELECT doc_id FROM labels)")
def j17_overlay_rejects(spark, d):
    patch = V.read(spark, d, "embeddings").filter("vec_id % 3 = 0").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("quality"))
    return R.overlay_rejects(V.read(spark, d, "labels"), patch, ["doc_id"])


@register("j16_details", f"""WITH {V.VERSIONS}, a AS (SELECT resource_id, max(version) AS active_version FROM versions WHERE status = 'active' GROUP BY 1), v AS (SELECT resource_id, list(version ORDER BY version DESC) AS versions FROM versions GROUP BY 1), o AS (SELECT l_partkey AS resource_id, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS options FROM lineitem GROUP BY 1),
 b AS (SELECT l_partkey AS resource_id, list(l_orderkey ORDER BY l_orderkey DESC) AS observations FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC) AS n FROM lineitem) WHERE n <= 5 GROUP BY 1)
 SELECT p_partkey AS id, active_version, options, versions, observations FROM part LEFT JOIN a ON a.resource_id = p_partkey LEFT JOIN v ON v.resource_id = p_partkey LEFT JOIN o ON o.resource_id = p_partkey LEFT JOIN b ON b.resource_id = p_partkey""")  # fmt: skip
def j16_details(spark, d):
    lines = V.read(spark, d, "lineitem")
    options = lines.select(F.col("l_partkey").alias("resource_id"), F.concat("l_returnflag", "l_linestatus").alias("option"))
    seen = lines.select(F.col("l_partkey").alias("resource_id"), F.col("l_orderkey").alias("observed_at"))
    return C.details(V.read(spark, d, "part").select(F.col("p_partkey").alias("id")), V.versions(spark, d), options, seen, 5)


@register("e27_artifact_hash_rows", """WITH h AS (SELECT sha256('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}') AS h FROM labels), p AS (SELECT substr(h, 1, 3) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1) SELECT sha256(string_agg(p || h, '' ORDER BY p || h)) AS sha256 FROM p""")
def e27_artifact_hash_rows(spark, d):
    return E.artifact_hash(V.read(spark, d, "labels"), ["doc_id"])


@register("e22_blinded_pack", "WITH g AS (SELECT source, row_number() OVER (ORDER BY sha256('z-group' || chr(0) || source), source) AS group_place FROM (SELECT DISTINCT source FROM documents)) SELECT 'b-' || substr(sha256('z-id' || chr(0) || source || '|' || doc_id), 1, 16) AS blind, group_place, row_number() OVER (PARTITION BY source ORDER BY sha256('z-row' || chr(0) || source || '|' || doc_id), doc_id) AS place FROM documents JOIN g USING (source)")
def e22_blinded_pack(spark, d):
    return E.blinded(V.read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", "z")[0]


@register("e22_owner_mapping", "SELECT 'b-' || substr(sha256('z-id' || chr(0) || source || '|' || doc_id), 1, 16) AS blind, source, doc_id FROM documents")
def e22_owner_mapping(spark, d):
    return E.blinded(V.read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", "z")[1]


@register("r1_odd_queries", r"SELECT item_id, substr(trim(regexp_replace('AB ' || text || ' fi', '\s+', ' ', 'g')), 1, 512) AS q FROM benchmark")
def r1_odd_queries(spark, d):
    odd = F.concat(F.lit("ＡＢ\x07‎ ‪"), "text", F.lit(" ﬁ"))
    return V.read(spark, d, "benchmark").select("item_id", T.normalize_query(odd).alias("q"))


_WORDS = r"list_filter(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), lambda w: NOT list_contains(" + str(list(T.STOPWORDS)) + ", w))"
_ASKED = "SELECT item_id, CASE item_id % 5 WHEN 0 THEN text WHEN 1 THEN 'get_user-profile of the https://api.example/v1' WHEN 2 THEN 'the of and' WHEN 3 THEN 'POST v2 invoice' ELSE 'weather' END AS t FROM benchmark"


def asked(spark, d):
    k = F.col("item_id")
    t = F.when(k % 5 == 0, F.col("text")).when(k % 5 == 1, "get_user-profile of the https://api.example/v1").when(k % 5 == 2, "the of and").when(k % 5 == 3, "POST v2 invoice").otherwise("weather")
    return V.read(spark, d, "benchmark").select("item_id", t.alias("t"))


@register("r4_all_features", rf"""WITH q AS ({_ASKED}), w AS (SELECT *, {_WORDS} AS w FROM q) SELECT item_id, CAST(length(t) AS INTEGER) AS normalized_length, len(w)::INT AS token_count, len(list_distinct(w))::INT AS unique_token_count, len(w)::INT AS phrase_token_count, len(w) > 1 AND regexp_matches(t, '\s') AS has_phrase, regexp_matches(t, '[_:/\\.@#%~-]') AS has_identifier,
 regexp_matches(t, '(?i)\b(https?|mcp)://') AS has_url, len(list_filter(w, lambda x: list_contains({list(T.METHODS)}, upper(x)))) > 0 AS has_http_method, len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) > 0 AS has_numeric_token, regexp_matches(t, '[^\p{{L}}\p{{N}}\s]') AS has_punctuation, length(t) > 0 AND len(w) = 0 AS stopword_only FROM w""")
def r4_all_features(spark, d):
    return asked(spark, d).select("item_id", T.query_shape(F.col("t")).alias("s")).select("item_id", "s.*")


@register("r3_any_of", rf"""WITH q AS ({_ASKED}), w AS (SELECT item_id, {_WORDS} AS p, list_filter(flatten(list_transform(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+(?:[_-][\p{{L}}\p{{N}}]+)*'), lambda x: list_concat([x], regexp_split_to_array(x, '[_-]+')))), lambda x: NOT list_contains({list(T.STOPWORDS)}, x)) AS i FROM q)
 SELECT item_id, CASE WHEN len(p) > 0 THEN p ELSE [] END AS phrase, CASE WHEN len(p) > 0 THEN list_sort(list_distinct(i)) ELSE [] END AS any_of FROM w""")
def r3_any_of(spark, d):
    return asked(spark, d).select("item_id", T.compile_query(F.col("t")).alias("q")).select("item_id", "q.phrase", F.sort_array("q.any_of").alias("any_of"))


_RULES = """list_filter([CASE WHEN p_size % 2 = 0 THEN 'type' END, CASE WHEN p_partkey % 3 = 0 THEN 'extensions' END, CASE WHEN p_partkey % 5 > 0 THEN 'payment_option' END, CASE WHEN p_retailprice > 1000 THEN 'price' END, CASE WHEN p_type <> 'ECONOMY' THEN 'category' END, CASE WHEN p_partkey % 7 <> 1 THEN 'freshness' END, CASE WHEN p_brand = 'Brand#2' THEN 'resource_type' END], lambda x: x IS NOT NULL)"""


@register("p12_seven_rules", f"SELECT p_partkey, {_RULES} AS reasons, {_RULES}[1] AS first_reason FROM part")
def p12_seven_rules(spark, d):
    c, k = F.col, F.col("p_partkey")
    filters = F.create_map(F.lit("network"), F.lit("net-0"), F.lit("scheme"), F.lit("exact"))
    # one single option must meet all payment filters: here its network is right for one in five, its scheme always
    option = F.struct(F.concat(F.lit("net-"), (k % 5).cast("string")).alias("network"), F.lit("exact").alias("scheme"), F.lit("p").alias("pay_to"), F.lit("a").alias("asset"))
    met = R.filters_met(filters, option, {"network": "network", "scheme": "scheme", "payTo": "pay_to", "asset": "asset"})
    rules = {"type": c("p_size") % 2 == 0, "extensions": k % 3 == 0, "payment_option": ~met, "price": c("p_retailprice") > 1000, "category": c("p_type") != "ECONOMY", "freshness": k % 7 != 1, "resource_type": c("p_brand") == "Brand#2"}
    return V.read(spark, d, "part").select("p_partkey", C.eligibility(rules).alias("reasons")).withColumn("first_reason", F.get("reasons", F.lit(0)))


@register("d4_search_documents", """SELECT p_partkey, array_to_string(list_filter(['Service: ' || p_name, CASE WHEN p_size % 2 = 0 THEN 'Description: ' || p_type END, CASE WHEN p_size % 3 = 0 THEN 'Type: MCP tool t' || p_size ELSE 'Type: HTTP GET' END, CASE WHEN p_size % 5 = 0 THEN 'Route: /a/:id' END, 'Resource: https://h/' || p_partkey, CASE WHEN p_size % 4 = 0 THEN 'Parameters:' || chr(10) || '- a (required): first' || chr(10) || '- b' END, CASE WHEN p_size % 7 = 0 THEN 'Output: json' END,
 'Tags: ' || p_brand || ', ' || p_type, 'MIME: a/b', CASE WHEN p_size % 6 = 0 THEN 'Examples:' || chr(10) || '- Input: x: 1' END, 'Payment: net, exact, 5 ' || CASE WHEN p_size % 2 = 0 THEN 'USD' ELSE 'a-1' END], lambda x: x IS NOT NULL), chr(10)) AS document, p_name || CASE WHEN p_size % 3 = 0 THEN ' mcp t' || p_size ELSE ' http get' END || CASE WHEN p_size % 5 = 0 THEN ' a id' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' https h ' ELSE ' https h ' END || p_partkey AS high FROM part""")
def d4_search_documents(spark, d):
    z, lit = F.col("p_size"), F.lit
    mcp = z % 3 == 0
    parameters = F.when(z % 4 == 0, F.array(F.struct(lit("b").alias("name"), lit(False).alias("required"), lit("").alias("description")), F.struct(lit("a").alias("name"), lit(True).alias("required"), lit("first").alias("description"))))
    option = F.struct(lit("net").alias("network"), lit("exact").alias("scheme"), lit("5").alias("amount"), F.when(z % 2 == 0, "USD").alias("symbol"), lit("a-1").alias("asset"), lit("p").alias("pay_to"))
    rows = V.read(spark, d, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.when(z % 2 == 0, F.col("p_type")).otherwise("").alias("description"), F.when(mcp, "mcp").otherwise("http").alias("type"), F.when(~mcp, "GET").alias("method"), F.when(mcp, F.concat(lit("t"), z)).alias("tool"),
        F.when(z % 5 == 0, "/a/:id").alias("route"), F.concat(lit("https://h/"), F.col("p_partkey").cast("string")).alias("url"), parameters.alias("parameters"), F.when(z % 7 == 0, "json").alias("output"), F.array("p_brand", "p_type").alias("tags"), lit("a/b").alias("mime"),
        lit(None).cast("string").alias("transport"), F.when(z % 6 == 0, F.array(lit("Input: x: 1"))).alias("examples"), F.array(option).alias("options"),
    )
    return R.search_document(rows).select("p_partkey", "document", "high")

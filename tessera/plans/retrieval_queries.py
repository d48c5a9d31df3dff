"""Registered queries for retrieval and its evaluation, each with its DuckDB form where SQL can express it."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluation as E
from tessera.operators import lexical as L
from tessera.operators import neighbours as N
from tessera.operators import retrieval as R
from tessera.operators.generations import Generations, Identity
from tessera.sources import views as V
from tessera.sources.scratch import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_BM25 = f"""dt AS (SELECT doc_id, {_TOK} AS t FROM documents), dl AS (SELECT doc_id, len(t) AS dl FROM dt), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM dt) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 q AS (SELECT item_id, unnest(list_distinct({_TOK})) AS term FROM benchmark),
 sc AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), c GROUP BY 1, 2),
 lex AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 20)"""


def lexical(spark, d):
    return L.bm25(V.read(spark, d, "documents"), V.read(spark, d, "benchmark"))


@register("r18_bm25", f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM lex")
def r18_bm25(spark, d):
    return lexical(spark, d)


_KNN = """qv AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
 dist AS (SELECT query_id, vec_id, round(1 - list_dot_product(embedding::DOUBLE[], q::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q::DOUBLE[], q::DOUBLE[]))), 6) + 0.0 AS distance FROM embeddings, qv),
 nn AS (SELECT * FROM (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id DESC) AS rank FROM dist) WHERE rank <= 20)"""


def nearest(spark, d):
    vectors = V.read(spark, d, "embeddings")
    return N.knn(vectors, vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), 20)


@register("r9_exact_knn", f"WITH {_KNN} SELECT query_id, vec_id, distance, rank FROM nn")
def r9_exact_knn(spark, d):
    return nearest(spark, d)


@register("r25_generations", """WITH v AS (SELECT vec_id AS key, embedding FROM embeddings), g AS (SELECT 1 AS generation, 'retired' AS status, key, embedding AS e FROM v UNION ALL SELECT 2, 'active', key, embedding[1:32] FROM v)
 SELECT generation, status, key, len(e) AS dimension, round(list_sum(list_transform(e, lambda x: x::DOUBLE)), 6) + 0.0 AS total FROM g""")
def r25_generations(spark, d):
    """Vectors of two generations: the first one's by a reader that pinned it before the switch to the second."""
    g = Generations(spark, f"{shared_folder(spark)}/tessera-generations-{uuid.uuid4().hex}")
    rows = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.lit("h").alias("source_hash"), "embedding")
    whole, half = (Identity("table", "given", "1", n) for n in (64, 32))
    day = datetime(2024, 1, 1)
    first = g.activate(whole, day)
    g.store(first.id, rows)
    pinned = g.state()
    second = g.create(half)
    g.store(second.id, rows.withColumn("embedding", F.slice("embedding", 1, 32)))
    g.activate(half, day + timedelta(days=1))
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6) + 0.0
    of = lambda df, x: df.select(F.lit(x.id).alias("generation"), F.lit(g.get(x.id).status).alias("status"), "key", F.size("embedding").alias("dimension"), total.alias("total"))
    return of(g.vectors(state=pinned), first).unionByName(of(g.vectors(), second))


@register("r5_any_term", f"WITH p AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS term FROM documents), q(qid, term) AS (VALUES (1, 'license'), (1, 'public'), (2, 'apache')) SELECT DISTINCT qid, doc_id FROM q JOIN p USING (term)")
def r5_any_term(spark, d):
    asked = spark.createDataFrame([(1, "license"), (1, "public"), (2, "apache")], "qid int, term string")
    return R.any_term(R.postings(V.read(spark, d, "documents"), "doc_id", "text"), asked, "doc_id", "qid")


@register("r7_phrase", f"WITH n AS (SELECT doc_id, ' ' || array_to_string({_TOK}, ' ') || ' ' AS t FROM documents), q(qid, p) AS (VALUES (1, ' apache license version '), (2, ' the mit license '), (3, ' gnu general public license ')) SELECT qid, doc_id FROM q JOIN n ON contains(t, p)")
def r7_phrase(spark, d):
    phrases = [(1, "apache license version"), (2, "the mit license"), (3, "gnu general public license")]
    asked = spark.createDataFrame([(q, i, w) for q, p in phrases for i, w in enumerate(p.split())], "qid int, i int, term string")
    return R.phrase(R.postings(V.read(spark, d, "documents"), "doc_id", "text"), asked, "doc_id", "qid")


@register("r6_cover_density", f"""WITH q(qid, term, t) AS (VALUES (1, 'license', 0), (1, 'version', 1), (2, 'license', 0), (2, 'mit', 1)), d AS (SELECT doc_id, {_TOK} AS w FROM documents), w AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d),
 p AS (SELECT qid, doc_id, t, pos, row_number() OVER (PARTITION BY qid, doc_id ORDER BY pos) AS i FROM w JOIN q USING (term)),
 l AS (SELECT qid, doc_id, i, pos, least(max(i) FILTER (t = 0) OVER s, max(i) FILTER (t = 1) OVER s) AS low, max(i) FILTER (t = 0) OVER s AS a, max(i) FILTER (t = 1) OVER s AS b FROM p WINDOW s AS (PARTITION BY qid, doc_id ORDER BY i)),
 c AS (SELECT l.qid, l.doc_id, l.i, l.pos, l.low, lag(l.low) OVER (PARTITION BY l.qid, l.doc_id ORDER BY l.i) AS before FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
 s AS (SELECT c.qid, c.doc_id, sum(0.45::DOUBLE / (1 + greatest(0, c.pos - f.pos - (c.i - c.low)))) AS r FROM c JOIN p f ON f.qid = c.qid AND f.doc_id = c.doc_id AND f.i = c.low WHERE before IS NULL OR low > before GROUP BY 1, 2)
 SELECT qid, doc_id, round(r / (r + 1), 9) AS score FROM s""")
def r6_cover_density(spark, d):
    asked = spark.createDataFrame([(1, "license"), (1, "version"), (2, "mit"), (2, "license")], "qid int, term string")
    post = R.postings(V.read(spark, d, "documents"), "doc_id", "text").withColumn("field", F.lit("medium"))
    return R.rank_cover_density(post, asked, "doc_id", "qid").withColumn("score", F.round("score", 9))




def _rrf(weights: list[tuple[str, float]], k: int) -> str:
    parts = " UNION ALL ".join(f"SELECT query_id, doc_id, {w} / ({k} + rank) AS s FROM {n}" for n, w in weights)
    return f"f AS (SELECT query_id, doc_id, round(sum(s), 9) AS score FROM ({parts}) GROUP BY 1, 2), fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM f)"


#: Two branches over one corpus: documents by BM25, and documents by shared long tokens.
_BRANCHES = f"""{_BM25}, a AS (SELECT item_id AS query_id, doc_id, rank FROM lex),
 b AS (SELECT query_id, doc_id, rank FROM (SELECT item_id AS query_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS rank FROM q JOIN tf USING (term) WHERE length(term) >= 4 GROUP BY 1, 2) WHERE rank <= 20)"""


def branches(spark, d):
    a = lexical(spark, d).select(F.col("item_id").alias("query_id"), "doc_id", "rank")
    b = L.shared_terms(V.read(spark, d, "documents"), V.read(spark, d, "benchmark"), 20, 4)
    return a, b.select(F.col("item_id").alias("query_id"), "doc_id", "rank")


def fused(spark, d):
    a, b = branches(spark, d)
    return R.fuse([(a, 0.3), (b, 0.7)], "query_id", "doc_id", k=20)


_FUSED = f"{_BRANCHES}, {_rrf([('a', 0.3), ('b', 0.7)], 20)}"


@register("r11_rank_fusion", f"WITH {_FUSED} SELECT query_id, doc_id, score, rank FROM fused")
def r11_rank_fusion(spark, d):
    return fused(spark, d)


@register("r12_threshold", f"WITH {_FUSED} SELECT query_id, doc_id, rank FROM fused WHERE score >= 0.03")
def r12_threshold(spark, d):
    return fused(spark, d).filter("score >= 0.03").select("query_id", "doc_id", "rank")


@register("r14_diversity", f"""WITH {_FUSED}, o AS (SELECT fused.*, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) > 2 AS late FROM fused JOIN documents USING (doc_id))
 SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS rank FROM o""")
def r14_diversity(spark, d):
    rows = fused(spark, d).join(V.read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return R.diversify(rows, "query_id", "source", 2).select("query_id", "doc_id", "rank")


@register("r13_rerank", f"""WITH {_FUSED}, t AS (SELECT fused.*, rank > 10 AS tail, CASE WHEN rank <= 10 THEN (doc_id * 7 + query_id) % 13 END AS new FROM fused)
 SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY tail, new DESC NULLS LAST, CASE WHEN tail THEN rank END, doc_id DESC) AS rank FROM t""")
def r13_rerank(spark, d):
    rows = fused(spark, d)
    scores = rows.filter("rank <= 10").select("query_id", "doc_id", ((F.col("doc_id") * 7 + F.col("query_id")) % 13).cast("double").alias("score"))
    return R.rerank(rows.select("query_id", "doc_id", "rank"), scores, "query_id", "doc_id", 10).select("query_id", "doc_id", "rank")


@register("r10_guard", f"WITH {_KNN}, lexq AS (SELECT query_id FROM qv WHERE query_id % 200 = 0) SELECT query_id, vec_id, distance FROM nn WHERE query_id IN (SELECT query_id FROM lexq) OR distance <= 0.6")
def r10_guard(spark, d):
    hits = V.read(spark, d, "embeddings").filter("vec_id % 200 = 0").select(F.col("vec_id").alias("query_id"))
    return R.guarded(nearest(spark, d), hits, "query_id", 0.6).select("query_id", "vec_id", "distance")


@register("r17_jaccard", f"""WITH {_BM25}, qt AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS s FROM benchmark), xt AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS s FROM documents)
 SELECT item_id, doc_id, round(len(list_intersect(qt.s, xt.s)) / len(list_distinct(list_concat(qt.s, xt.s))), 6) AS j FROM lex JOIN qt USING (item_id) JOIN xt USING (doc_id)""")
def r17_jaccard(spark, d):
    """The reranker's score of each query with each of its lexical candidates."""
    words = lambda c: F.array_distinct(T.tokens(F.col(c), T.ASCII_TOKEN))
    docs = V.read(spark, d, "documents").select("doc_id", words("text").alias("y"))
    items = V.read(spark, d, "benchmark").select("item_id", words("text").alias("x"))
    pairs = lexical(spark, d).select("item_id", "doc_id").join(items, "item_id").join(docs, "doc_id")
    return pairs.select("item_id", "doc_id", F.round(R.jaccard(F.col("x"), F.col("y")), 6).alias("j"))


@register("r24_vector_check", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS valid FROM embeddings")
def r24_vector_check(spark, d):
    return V.read(spark, d, "embeddings").select("vec_id", R.valid_vector(F.col("embedding"), 64).alias("valid"))


#: Judgments: synthetic grades on labelled documents; a document without a label is unjudged.
_QRELS = "qr AS (SELECT item_id AS query_id, doc_id, (doc_id * 7 + item_id * 3) % 4 AS grade FROM benchmark, labels WHERE doc_id % 11 = item_id % 11)"


def qrels(spark, d):
    labels = V.read(spark, d, "labels").select("doc_id", (F.col("doc_id") % 11).alias("m"))
    items = V.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 11).alias("m"))
    return labels.join(items, "m").select("query_id", "doc_id", ((F.col("doc_id") * 7 + F.col("query_id") * 3) % 4).cast("int").alias("grade"))


_KS = (1, 3, 5, 10)


def _metrics_sql(undefined: str) -> str:
    return f"""WITH {_BM25}, {_QRELS}, run AS (SELECT item_id AS query_id, doc_id, rank FROM lex), ks(k) AS (VALUES (1), (3), (5), (10)),
 j AS (SELECT run.*, grade, coalesce(sum((grade < 2)::INT) OVER (PARTITION BY run.query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bad FROM run LEFT JOIN qr USING (query_id, doc_id)),
 i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM qr),
 t AS (SELECT query_id, k, count(*) FILTER (WHERE grade >= 2) AS relevant, count(*) AS jt, sum((power(2, grade) - 1) / log2(i + 1)) FILTER (WHERE i <= k) AS ideal FROM i, ks GROUP BY 1, 2),
 s AS (SELECT query_id, k, count(*) AS returned, min(rank) FILTER (WHERE grade >= 2) AS first, count(*) FILTER (WHERE rank <= k AND grade >= 2) AS hits, count(*) FILTER (WHERE rank <= k AND grade IS NULL) AS unjudged, count(*) FILTER (WHERE rank <= k AND grade = 0) AS zero, coalesce(sum((power(2, grade) - 1) / log2(rank + 1)) FILTER (WHERE rank <= k), 0) AS dcg FROM j, ks GROUP BY 1, 2),
 bp AS (SELECT j.query_id, sum(CASE WHEN least(relevant, jt - relevant) = 0 THEN 1 ELSE 1 - least(bad, relevant) / least(relevant, jt - relevant) END) / any_value(relevant) AS bpref FROM j JOIN t ON t.query_id = j.query_id AND t.k = 1 WHERE grade >= 2 GROUP BY 1)
 SELECT b.item_id AS query_id, ks.k, coalesce(relevant, 0) AS relevant, coalesce(returned, 0) AS returned, round(CASE WHEN coalesce(relevant, 0) = 0 THEN {undefined} ELSE coalesce(hits, 0) / relevant END, 6) AS recall, round(coalesce(hits, 0) / ks.k, 6) AS "precision",
 round(CASE WHEN coalesce(ideal, 0) = 0 THEN {undefined} ELSE coalesce(dcg, 0) / ideal END, 6) AS ndcg, coalesce(unjudged, 0) AS unjudged, coalesce(zero, 0) AS explicit_zero,
 round(CASE WHEN first IS NOT NULL THEN 1 / first WHEN {undefined} IS NOT NULL OR coalesce(relevant, 0) > 0 THEN 0 END, 6) AS mrr, round(CASE WHEN coalesce(relevant, 0) > 0 THEN coalesce(bpref, 0) END, 6) AS bpref
 FROM benchmark b CROSS JOIN ks LEFT JOIN t ON t.query_id = b.item_id AND t.k = ks.k LEFT JOIN s ON s.query_id = b.item_id AND s.k = ks.k LEFT JOIN bp ON bp.query_id = b.item_id"""


def metrics(spark, d, as_one, ranked=None):
    """Metrics of the lexical run; ranked: that run where it is written already."""
    run = (lexical(spark, d) if ranked is None else ranked).select(F.col("item_id").alias("query_id"), "doc_id", "rank")
    queries = V.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return E.query_metrics(run, qrels(spark, d), queries, _KS, as_one)


def _shown(m):
    c = ["recall", "precision", "ndcg", "mrr", "bpref"]
    return m.select("query_id", "k", "relevant", "returned", *[F.round(x, 6).alias(x) for x in c], "unjudged", "explicit_zero")


@register("e1_metrics_defined", _metrics_sql("1"))
def e1_metrics_defined(spark, d):
    return _shown(metrics(spark, d, True))


@register("e3_metrics_nullable", _metrics_sql("NULL"))
def e3_metrics_nullable(spark, d):
    return _shown(metrics(spark, d, False))


@register("e4_macro_means", f"SELECT k, round(avg(recall), 4) AS recall, count(recall) AS recall_support, round(avg(ndcg), 4) AS ndcg, count(ndcg) AS ndcg_support FROM ({_metrics_sql('NULL')}) GROUP BY 1")
def e4_macro_means(spark, d):
    return E.macro(_shown(metrics(spark, d, False)), ["k"], ("recall", "ndcg"), 4)


@register("a20_micro_unjudged", f"SELECT k, round(sum(unjudged) / sum(least(k, returned)), 6) AS unjudged_rate FROM ({_metrics_sql('NULL')}) GROUP BY 1")
def a20_micro_unjudged(spark, d):
    return E.micro_unjudged(metrics(spark, d, False), ["k"]).withColumn("unjudged_rate", F.round("unjudged_rate", 6))


@register("a21_nearest_rank", "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def a21_nearest_rank(spark, d):
    return E.nearest_rank(V.read(spark, d, "events"), "value")


@register("u1_pool", f"WITH {_BRANCHES}, u AS (SELECT query_id, doc_id, 'a' AS system, rank FROM a WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 'b', rank FROM b WHERE rank <= 10) SELECT query_id, doc_id, string_agg(system || ':' || rank, ',' ORDER BY system) AS contributions, min(rank)::INT AS best_rank FROM u GROUP BY 1, 2")
def u1_pool(spark, d):
    a, b = branches(spark, d)
    p = E.pool({"a": a, "b": b}, 10, "query_id", "doc_id")
    return p.withColumn("contributions", F.array_join(F.transform("contributions", lambda x: F.concat(x["system"], F.lit(":"), x["rank"].cast("string"))), ","))


@register("u5_unjudged_pairs", f"WITH {_BM25}, {_QRELS} SELECT item_id AS query_id, doc_id FROM lex ANTI JOIN qr ON qr.query_id = lex.item_id AND qr.doc_id = lex.doc_id")
def u5_unjudged_pairs(spark, d):
    run = lexical(spark, d).select(F.col("item_id").alias("query_id"), "doc_id")
    return run.join(qrels(spark, d), ["query_id", "doc_id"], "left_anti")


_PAIRS = "SELECT doc_id % 4 AS a, (doc_id % 4 + CASE WHEN quality = 0 THEN 1 ELSE 0 END + toxic) % 4 AS b FROM labels"


def pairs(spark, d):
    a = F.col("doc_id") % 4
    return V.read(spark, d, "labels").select(a.alias("a"), ((a + F.when(F.col("quality") == 0, 1).otherwise(0) + F.col("toxic")) % 4).alias("b"))


@register("a24_confusion", f"WITH p AS ({_PAIRS}) SELECT a.range::INT AS a, b.range::INT AS b, (SELECT count(*) FROM p WHERE p.a = a.range AND p.b = b.range) AS n FROM range(4) a, range(4) b")
def a24_confusion(spark, d):
    return E.confusion(pairs(spark, d))


for _name, _power in (("quadratic", 2), ("linear", 1)):
    @register(f"e5_kappa_{_name}", f"""WITH p AS ({_PAIRS}), n AS (SELECT count(*) AS n FROM p), o AS (SELECT sum(power(abs(a - b) / 3, {_power})) AS o FROM p),
 r AS (SELECT a, count(*) AS ra FROM p GROUP BY 1), c AS (SELECT b, count(*) AS cb FROM p GROUP BY 1), e AS (SELECT sum(power(abs(a - b) / 3, {_power}) * ra * cb) AS e FROM r, c) SELECT n, round(1 - (o / n) / (e / (n * n)), 6) AS kappa FROM n, o, e""")
    def e5_kappa(spark, d, quadratic=_power == 2):
        return E.weighted_kappa(pairs(spark, d), 4, quadratic).select("n", F.round("kappa", 6).alias("kappa"))


@register("e11_cramers_v", "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY 1, 2), n AS (SELECT sum(o) AS n FROM c), r AS (SELECT a, sum(o) AS ra FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS cb FROM c GROUP BY 1), x AS (SELECT sum(power(coalesce(o, 0) - ra * cb / n, 2) / (ra * cb / n)) AS chi FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = k.b) SELECT round(sqrt(chi / (n * least((SELECT count(*) FROM r) - 1, (SELECT count(*) FROM k) - 1))), 4) AS v, CAST(n AS BIGINT) AS n FROM x, n")
def e11_cramers_v(spark, d):
    return E.cramers_v(V.read(spark, d, "lineitem"), "l_returnflag", "l_linestatus").select(F.round("v", 4).alias("v"), "n")


@register("e7_exact_permutation", "WITH v AS (SELECT c_nationkey % 18 AS i, round(avg(c_acctbal) - 4400) AS x FROM customer GROUP BY 1), m AS (SELECT range AS mask FROM range(262144)), s AS (SELECT mask, sum(CASE WHEN (mask >> i) & 1 = 0 THEN x ELSE -x END) AS t FROM m, v GROUP BY 1), o AS (SELECT abs(sum(x)) AS o, count(*) AS n FROM v) SELECT n::INT AS n, round(o / n, 6) AS observed, round(avg((abs(t) >= o - 1e-12)::INT), 9) AS p FROM s, o GROUP BY n, o")
def e7_exact_permutation(spark, d):
    x = V.read(spark, d, "customer").groupBy(F.col("c_nationkey") % 18).agg(F.round(F.avg("c_acctbal") - 4400).alias("d"))
    return E.exact_permutation(x.select("d")).select("n", F.round("observed", 6).alias("observed"), F.round("p", 9).alias("p"))


@register("e10_compare_runs")
def e10_compare_runs(spark, d):
    a, b = branches(spark, d)
    queries = V.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    one, two = (E.query_metrics(x, qrels(spark, d), queries, (10,)).select("query_id", F.col("ndcg").alias(n)) for x, n in ((a, "base"), (b, "cand")))
    return E.compare_runs(one.join(two, "query_id").withColumn("comparison", F.lit("a-b")), "ndcg", iterations=2000)


@register("e16_staged_sample", f"""WITH {_BRANCHES}, {_QRELS}, x AS (SELECT query_id, doc_id, 0 AS stage, lpad(row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id)::VARCHAR, 12, '0') AS o FROM a ANTI JOIN qr USING (query_id, doc_id)), y AS (SELECT query_id, doc_id, 1 AS stage, lpad(row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id)::VARCHAR, 12, '0') AS o FROM b ANTI JOIN qr USING (query_id, doc_id)),
 z AS (SELECT item_id AS query_id, doc_id, 2 AS stage, sha256('s' || chr(0) || item_id || '|' || doc_id) AS o FROM benchmark JOIN labels ON doc_id % 3 = item_id % 3 ANTI JOIN qr ON qr.query_id = item_id AND qr.doc_id = labels.doc_id), w AS (SELECT * FROM x WHERE o <= '000000000003' UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z),
 f AS (SELECT query_id, doc_id, stage, o FROM w QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY stage, o) = 1), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY stage, o, doc_id) AS p FROM f) SELECT query_id, doc_id, stage, count(*) OVER (PARTITION BY query_id) < 40 AS exhausted FROM p WHERE p <= 40""")
def e16_staged_sample(spark, d):
    a, b = (x.withColumnRenamed("rank", "priority") for x in branches(spark, d))
    labels = V.read(spark, d, "labels").select("doc_id", (F.col("doc_id") % 3).alias("m"))
    rest = V.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 3).alias("m")).join(labels, "m").select("query_id", "doc_id")
    return E.staged_sample([(a, 3), (b, None)], rest, qrels(spark, d), "query_id", "doc_id", 40, "s")


@register("e17_adjudicated", "SELECT doc_id, quality AS a, toxic AS b, quality = toxic AS agreed, CASE WHEN quality = toxic THEN quality WHEN doc_id % 2 = 0 THEN 1 END AS grade FROM labels")
def e17_adjudicated(spark, d):
    rows = V.read(spark, d, "labels")
    choice = rows.filter("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("grade"))
    return E.adjudicated(rows.select("doc_id", F.col("quality").alias("grade")), rows.select("doc_id", F.col("toxic").alias("grade")), choice, ["doc_id"])


@register("e22_blinded_ids", "SELECT doc_id, 'b-' || substr(sha256('pack' || chr(0) || doc_id), 1, 12) AS blind, row_number() OVER (PARTITION BY source ORDER BY sha256('order' || chr(0) || doc_id), doc_id) AS place FROM documents")
def e22_blinded_ids(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(T.seeded("order", F.col("doc_id")), "doc_id")
    return V.read(spark, d, "documents").select("doc_id", F.concat(F.lit("b-"), F.substring(T.seeded("pack", F.col("doc_id")), 1, 12)).alias("blind"), F.row_number().over(w).alias("place"))


@register("e27_artifact_hash")
def e27_artifact_hash(spark, d):
    return E.artifact_hash(V.read(spark, d, "labels"), ["doc_id"])

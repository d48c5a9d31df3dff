"""Registered queries over the catalog views, text and URL functions, records, sets and samples."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import urls as U
from tessera.operators import catalog as C
from tessera.operators import evaluation as E
from tessera.sources import views as V
from tessera.sources.scratch import shared_folder, written
from tessera.sources.views import OPTIONS, RESOURCES, VERSIONS
from tessera.streaming import folds as S
from tessera.streaming.sink import AppendSink, UpsertSink, in_parts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str):
    def put(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


SNAP = "created_version <= 30 AND (retired_version IS NULL OR retired_version > 30)"


@register("p3_snapshot", f"WITH {RESOURCES} SELECT id, origin, status FROM resources WHERE {SNAP}")
def p3_snapshot(spark, d):
    return V.resources(spark, d).filter(C.in_snapshot(30)).select("id", "origin", "status")


@register("p4_visible_page", f"WITH {RESOURCES} SELECT id, origin FROM resources WHERE {SNAP} AND status IN ('active', 'stale') AND verification = 'payment_observed' ORDER BY id DESC LIMIT 50 OFFSET 50")
def p4_visible_page(spark, d):
    rows = V.resources(spark, d).filter(C.in_snapshot(30) & C.visible(("active", "stale"), paid_only=True))
    return rows.orderBy(F.desc("id")).offset(50).limit(50).select("id", "origin")


@register("p5_json_key", "SELECT event_id FROM events WHERE list_contains(json_keys(props), 'k') AND event_type = 'signup'")
def p5_json_key(spark, d):
    return V.read(spark, d, "events").filter((F.col("event_type") == "signup") & C.has_key("props", "k")).select("event_id")


@register("p6_substring_bonus", f"WITH {RESOURCES} SELECT id, CASE WHEN contains(lower(concat_ws(' ', name, category)), 'red') THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS bonus FROM resources")
def p6_substring_bonus(spark, d):
    return V.resources(spark, d).select("id", C.substring_bonus("RED", "name", "category").alias("bonus"))


@register("p9_redact", "SELECT c_custkey, CASE WHEN length(c_name) > 12 THEN substr(c_name, 1, 6) || '…' || right(c_name, 4) ELSE c_name END AS short FROM customer")
def p9_redact(spark, d):
    return V.read(spark, d, "customer").select("c_custkey", T.redact(F.col("c_name")).alias("short"))


@register("p11_joint_options", f"WITH {RESOURCES}, {OPTIONS} SELECT id FROM resources WHERE EXISTS (SELECT 1 FROM options o WHERE o.resource_id = id AND o.network = 'net-1' AND o.scheme = 'A' AND o.asset = 'asset-2' AND o.amount <= 3000000)")
def p11_joint_options(spark, d):
    return C.with_option(V.resources(spark, d), V.options(spark, d), network="net-1", scheme="A", asset="asset-2", max_amount=3000000).select("id")


_REASONS = "list_filter([CASE WHEN status = 'quarantined' THEN 'unsafe' END, CASE WHEN status = 'stale' THEN 'stale' END, CASE WHEN price > 120000 THEN 'price' END, CASE WHEN category <> 'ECONOMY' THEN 'category' END, CASE WHEN type <> 'http' THEN 'type' END], lambda x: x IS NOT NULL)"


@register("p12_eligibility", f"WITH {RESOURCES} SELECT id, {_REASONS} AS reasons, {_REASONS}[1] AS first_reason FROM resources")
def p12_eligibility(spark, d):
    c = F.col
    reasons = C.eligibility({"unsafe": c("status") == "quarantined", "stale": c("status") == "stale", "price": c("price") > 120000, "category": c("category") != "ECONOMY", "type": c("type") != "http"})
    return V.resources(spark, d).select("id", reasons.alias("reasons")).withColumn("first_reason", F.get("reasons", F.lit(0)))


@register("p13_precedence", f"WITH {RESOURCES} SELECT id, CASE WHEN status = 'quarantined' THEN 'unsafe' WHEN status = 'stale' THEN 'stale' WHEN type = 'mcp' THEN 'incompatible' ELSE 'eligible' END AS class FROM resources")
def p13_precedence(spark, d):
    return V.resources(spark, d).select("id", C.precedence(("unsafe", F.col("status") == "quarantined"), ("stale", F.col("status") == "stale"), ("incompatible", F.col("type") == "mcp")).alias("class"))


_LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY resource_id ORDER BY version DESC) AS r FROM versions WHERE version <= 3200 AND status IN ('active', 'superseded')) WHERE r = 1)"


@register("j1_latest_version", f"WITH {VERSIONS}, {_LATEST} SELECT resource_id, version, pay_to, line_status, status FROM l")
def j1_latest_version(spark, d):
    return C.latest_version(V.versions(spark, d), 3200)


@register("j3_snapshot_join", f"WITH {VERSIONS}, {_LATEST}, {RESOURCES} SELECT id, origin, l.version, l.pay_to FROM resources JOIN l ON id = resource_id WHERE {SNAP}")
def j3_snapshot_join(spark, d):
    latest = C.latest_version(V.versions(spark, d), 3200).select("resource_id", "version", "pay_to")
    return V.resources(spark, d).filter(C.in_snapshot(30)).join(latest, F.col("id") == F.col("resource_id")).select("id", "origin", "version", "pay_to")


@register("j4_active_version", f"WITH {VERSIONS}, {RESOURCES}, a AS (SELECT resource_id, max(version) AS active_version FROM versions WHERE status = 'active' GROUP BY 1) SELECT id, active_version FROM resources LEFT JOIN a ON id = resource_id")
def j4_active_version(spark, d):
    return C.with_active(V.resources(spark, d), V.versions(spark, d)).select("id", "active_version")


@register("j5_semi", f"WITH {RESOURCES}, {OPTIONS} SELECT id FROM resources WHERE id IN (SELECT resource_id FROM options WHERE scheme = 'N' AND amount < 500000)")
def j5_semi(spark, d):
    keys = V.options(spark, d).filter("scheme = 'N' and amount < 500000").select(F.col("resource_id").alias("id"))
    return C.fetch(V.resources(spark, d), keys).select("id")


@register("j7_missing_vectors", "SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = doc_id)")
def j7_missing_vectors(spark, d):
    have = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return C.missing(V.read(spark, d, "documents").select("doc_id"), have, "doc_id")


@register("j8_compare", "WITH e AS (SELECT doc_id AS id, quality AS v FROM labels), a AS (SELECT vec_id AS id, label AS v FROM embeddings) SELECT coalesce(e.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'extra' ELSE 'unequal' END AS difference FROM e FULL JOIN a ON e.id = a.id WHERE a.id IS NULL OR e.id IS NULL OR e.v IS DISTINCT FROM a.v")
def j8_compare(spark, d):
    expected = V.read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("v"))
    return C.compare(expected, V.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("v")), ["id"], "v")


@register("j13_siblings_alike", "SELECT a.p_brand AS family, a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey WHERE (a.p_type <> b.p_type)::INT + (a.p_size <> b.p_size)::INT + (a.p_name <> b.p_name)::INT < 2")
def j13_siblings_alike(spark, d):
    return C.siblings_alike(V.read(spark, d, "part").withColumnRenamed("p_brand", "family"), "family", "p_partkey", ["p_type", "p_size", "p_name"])


@register("j16_detail_versions", f"WITH {VERSIONS} SELECT resource_id, list(version ORDER BY version DESC) AS versions, count(*) AS n FROM versions GROUP BY 1")
def j16_detail_versions(spark, d):
    mine = V.versions(spark, d)
    return mine.groupBy("resource_id").agg(F.sort_array(F.collect_list("version"), asc=False).alias("versions"), F.count("*").alias("n"))


@register("a18_totals", f"WITH {RESOURCES} SELECT count(*) FILTER (WHERE {SNAP} AND status = 'active') AS total, count(*) FILTER (WHERE {SNAP}) AS snapshot_total FROM resources")
def a18_totals(spark, d):
    return C.totals(V.resources(spark, d), F.col("status") == "active", C.in_snapshot(30))


@register("a17_coverage", "SELECT count(*) AS expected, count(vec_id) AS indexed, count(*) FILTER (WHERE vec_id IS NULL) AS pending FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def a17_coverage(spark, d):
    both = V.read(spark, d, "documents").select("doc_id").join(V.read(spark, d, "embeddings").select("vec_id"), F.col("doc_id") == F.col("vec_id"), "left")
    return both.agg(F.count("*").alias("expected"), F.count("vec_id").alias("indexed"), F.count_if(F.col("vec_id").isNull()).alias("pending"))


@register("a22_rate", "SELECT source, coalesce(round(avg(quality), 6), 0) AS rate, count(quality) AS support FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a22_rate(spark, d):
    rows = V.read(spark, d, "documents").select("doc_id", "source").join(V.read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return C.rate_by(rows, "source", "quality").withColumn("rate", F.round("rate", 6))


@register("a23_frequency", "SELECT source, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)")
def a23_frequency(spark, d):
    return C.frequency(V.read(spark, d, "documents"), "source").withColumn("share", F.round("share", 6))


@register("a25_group_limits", "SELECT p_brand, count(DISTINCT p_type) AS types, max(n) AS largest FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) GROUP BY 1")
def a25_group_limits(spark, d):
    return C.group_limits(V.read(spark, d, "part"), "p_brand", "p_type").withColumnRenamed("members", "types")


@register("a26_name_lists", "SELECT p_brand, list_sort(list(DISTINCT p_name)) AS names FROM part GROUP BY 1")
def a26_name_lists(spark, d):
    return C.name_lists(V.read(spark, d, "part"), "p_brand", "p_name")


@register("w8_next_version", f"WITH {VERSIONS}, n AS (SELECT DISTINCT l_partkey AS resource_id, l_suppkey AS s FROM lineitem), m AS (SELECT resource_id, max(version) AS v FROM versions GROUP BY 1) SELECT n.resource_id, s, coalesce(v, 0) + row_number() OVER (PARTITION BY n.resource_id ORDER BY s) AS version FROM n LEFT JOIN m ON n.resource_id = m.resource_id")
def w8_next_version(spark, d):
    new = V.read(spark, d, "lineitem").select(F.col("l_partkey").alias("resource_id"), F.col("l_suppkey").alias("s")).distinct()
    return C.next_versions(V.versions(spark, d), new, "resource_id", "s").select("resource_id", "s", "version")


@register("w9_round_robin", "WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY sha256('s' || chr(0) || p_partkey), p_partkey) AS t FROM part) SELECT p_partkey, p_type FROM r ORDER BY t, sha256('s' || chr(0) || p_type), p_type LIMIT 37")
def w9_round_robin(spark, d):
    return E.stratified(V.read(spark, d, "part").select("p_partkey", "p_type"), ["p_type"], "p_partkey", 37, "s")


@register("o5_nulls_first", f"WITH {RESOURCES} SELECT id, retired_version FROM resources ORDER BY retired_version NULLS FIRST, id")
def o5_nulls_first(spark, d):
    return V.resources(spark, d).select("id", "retired_version").orderBy(F.asc_nulls_first("retired_version"), "id")


@register("o8_seeded_order", "SELECT c_custkey, sha256('seed-1' || chr(0) || c_custkey) AS k FROM customer ORDER BY k, c_custkey")
def o8_seeded_order(spark, d):
    rows = V.read(spark, d, "customer").select("c_custkey", T.seeded("seed-1", F.col("c_custkey")).alias("k"))
    return rows.orderBy("k", "c_custkey")


@register("u2_set_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u2_set_difference(spark, d):
    return V.read(spark, d, "documents").select("doc_id").subtract(V.read(spark, d, "labels").select("doc_id"))


@register("u3_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def u3_duplicates(spark, d):
    return C.duplicates(V.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("u4_ordered_union", "SELECT conv_id, list_slice(list_distinct(list(role ORDER BY turn)), 1, 2) IS NOT NULL AS ok, len(list_distinct(list(role))) AS n FROM conversations GROUP BY 1")
def u4_ordered_union(spark, d):
    roles = V.read(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    first = F.slice(F.array_distinct(F.transform("r", lambda x: x["role"])), 1, 2)
    return roles.select("conv_id", first.isNotNull().alias("ok"), F.size(F.array_distinct(F.transform("r", lambda x: x["role"]))).cast("bigint").alias("n"))


@register("u7_id_gaps", "SELECT g.range AS doc_id FROM range(0, (SELECT max(doc_id) + 1 FROM labels)) g WHERE g.range NOT IN (SELECT doc_id FROM labels)")
def u7_id_gaps(spark, d):
    return C.id_gaps(V.read(spark, d, "labels").select("doc_id"), "doc_id")


@register("r2_token_counts", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{2,}'))) AS long_tokens FROM documents")
def r2_token_counts(spark, d):
    t = F.col("text")
    return V.read(spark, d, "documents").select("doc_id", F.size(T.tokens(t)).cast("bigint").alias("n"), F.size(F.array_distinct(T.tokens(t, T.LONG_TOKEN))).cast("bigint").alias("long_tokens"))


_SEARCH = "list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: NOT list_contains(" + str(list(T.STOPWORDS)) + ", w))"


@register("r3_compiled_queries", f"SELECT item_id, {_SEARCH} AS phrase, len({_SEARCH}) = 0 AS no_match FROM benchmark")
def r3_compiled_queries(spark, d):
    q = V.read(spark, d, "benchmark").select("item_id", T.compile_query(F.col("text")).alias("q"))
    return q.select("item_id", "q.phrase", (F.size("q.any_of") == 0).alias("no_match"))


@register("r4_query_shape", f"SELECT item_id, CAST(len({_SEARCH}) AS BIGINT) AS token_count, CAST(len(list_distinct({_SEARCH})) AS BIGINT) AS unique_token_count, regexp_matches(text, '[_:/\\\\.@#%~-]') AS has_identifier, regexp_matches(text, '[^\\p{{L}}\\p{{N}}\\s]') AS has_punctuation FROM benchmark")
def r4_query_shape(spark, d):
    s = V.read(spark, d, "benchmark").select("item_id", T.query_shape(F.col("text")).alias("s"))
    return s.select("item_id", F.col("s.token_count").cast("bigint").alias("token_count"), F.col("s.unique_token_count").cast("bigint").alias("unique_token_count"), "s.has_identifier", "s.has_punctuation")


@register("r8_unique_lexemes", "WITH t AS (SELECT item_id, unnest(l) AS w, unnest(range(1, len(l) + 1)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS l FROM benchmark)), f AS (SELECT item_id, w, min(i) AS i FROM t GROUP BY 1, 2) SELECT item_id, string_agg(w, ' ' ORDER BY i) AS lexemes FROM f GROUP BY 1")
def r8_unique_lexemes(spark, d):
    return V.read(spark, d, "benchmark").select("item_id", T.unique_lexemes(F.col("text")).alias("lexemes"))


@register("d9_forbidden_phrases", "WITH n AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS t FROM documents), s(phrase) AS (VALUES ('apache license'), ('mit license'), ('cc by'), ('general public')) SELECT doc_id, phrase FROM n JOIN s ON contains(t, ' ' || phrase || ' ')")
def d9_forbidden_phrases(spark, d):
    padded = V.read(spark, d, "documents").select("doc_id", T.phrase_token_text(F.col("text")).alias("t"))
    return padded.select("doc_id", F.explode(C.phrases_found(F.col("t"), ["apache license", "mit license", "cc by", "general public"])).alias("phrase"))


@register("d2_identity_keys", "SELECT page_id, 'http|' || lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)) || '|' || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) || '|GET' AS k, 'eco-' || substr(sha256(url), 1, 16) AS cid FROM pages")
def d2_identity_keys(spark, d):
    return V.read(spark, d, "pages").select("page_id", U.identity_key(F.lit("http"), F.col("url"), F.lit("get")).alias("k"), U.content_id(F.col("url")).alias("cid"))


@register("d6_normalized_urls", "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)) || regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS u FROM pages")
def d6_normalized_urls(spark, d):
    return V.read(spark, d, "pages").select("page_id", U.normalize(F.col("url")).alias("u"))


@register("d7_merge_duplicates", "WITH p AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h FROM pages) SELECT h, max(length(html)) AS metric, min(page_id % 5) AS status_rank, list_sort(list(DISTINCT page_id % 7)) AS sources FROM p GROUP BY 1")
def d7_merge_duplicates(spark, d):
    pages = V.read(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("h"), F.col("html").alias("description"), F.length("html").cast("bigint").alias("metric"), (F.col("page_id") % 5).alias("status_rank"), (F.col("page_id") % 7).alias("source"), F.col("page_id").alias("observed_at"))
    return C.merge_duplicates(pages, "h").select("h", "metric", "status_rank", "sources")


@register("d17_status_lattice", "SELECT source, CASE WHEN bool_and(quality IS NULL) THEN 'empty' WHEN bool_and(quality = 1) THEN 'success' WHEN bool_or(quality = 1) THEN 'partial' ELSE 'invalid' END AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def d17_status_lattice(spark, d):
    rows = V.read(spark, d, "documents").select("doc_id", "source").join(V.read(spark, d, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(C.joint_status(F.col("quality") == 1).alias("status"))


@register("d18_integrity", "SELECT 'duplicate_ids' AS name, count(*) AS observed, count(*) = 0 AS passed FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'orphan_labels', count(*), count(*) = 0 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'unlabelled', count(*), count(*) = 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def d18_integrity(spark, d):
    docs, labels = V.read(spark, d, "documents").select("doc_id"), V.read(spark, d, "labels").select("doc_id")
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    return E.checks({"duplicate_ids": twice, "orphan_labels": C.missing(labels, docs, "doc_id"), "unlabelled": C.missing(docs, labels, "doc_id")})


@register("x1_last_write", "SELECT * FROM (SELECT l_orderkey, l_linenumber, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2)")
def x1_last_write(spark, d):
    return S.last_write(V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("last")), ["l_orderkey", "l_linenumber"], "last")


_ORDERED = "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice) AS seq, l_returnflag AS dim, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount FROM lineitem"


@register("x1_retractions", f"WITH o AS ({_ORDERED}), l AS (SELECT l_orderkey, l_linenumber, arg_max(dim, seq) AS dim, arg_max(amount, seq) AS amount FROM o GROUP BY 1, 2), d AS (SELECT DISTINCT dim FROM o) SELECT d.dim, count(l.dim) AS transactions, CAST(coalesce(sum(amount), 0) AS BIGINT) AS amount FROM d LEFT JOIN l ON d.dim = l.dim GROUP BY 1")
def x1_retractions(spark, d):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = V.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct(*order).alias("seq"), F.col("l_returnflag").alias("dim"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"))
    return S.retractions(rows, ["l_orderkey", "l_linenumber"], "seq", ["dim"], "amount")


@register("x1_stream_upserts", f"WITH o AS ({_ORDERED}), l AS (SELECT l_orderkey, l_linenumber, arg_max(dim, seq) AS dim, arg_max(amount, seq) AS amount FROM o GROUP BY 1, 2), d AS (SELECT DISTINCT dim FROM o) SELECT d.dim, count(l.dim) AS transactions, CAST(coalesce(sum(amount), 0) AS BIGINT) AS amount FROM d LEFT JOIN l ON d.dim = l.dim GROUP BY 1")
def x1_stream_upserts(spark, d):
    """The rollup that a stream of the line items leaves behind, read from the table's files in three micro-batches dealt by line."""
    source = V.read(spark, d, "lineitem")
    where = f"{shared_folder(spark)}/tessera-stream-{uuid.uuid4().hex}"
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/lineitem.parque[t]")  # a pattern, as one file is no folder
    rows = stream.select("l_orderkey", "l_linenumber", F.struct(*order).alias("seq"), F.col("l_returnflag").alias("dim"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("amount"))
    sink = UpsertSink(spark, f"{where}/sink", ["l_orderkey", "l_linenumber"], "seq", ["dim"], "amount", buckets=8)
    # writes of one line come in several batches
    write = in_parts(sink.write, 3, ["l_orderkey", "l_linenumber", "seq"])
    rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return written(sink.rollup(), "rollup")


@register("x18_append_once", "SELECT event_id, ts, user_id, event_type FROM events")
def x18_append_once(spark, d):
    """The log of all events, sent in two batches that share a third of them, and the second of them twice."""
    rows = V.read(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    log = AppendSink(spark, f"{shared_folder(spark)}/tessera-log-{uuid.uuid4().hex}", ["event_id"], buckets=8)
    third = F.pmod(F.xxhash64("event_id"), F.lit(3))
    for n, part in enumerate((rows.filter(third < 2), rows.filter(third > 0), rows.filter(third > 0))):
        log.write(part, n)
    return log.events()


@register("x5_stale", "SELECT user_id, CASE WHEN max(ts) < TIMESTAMP '2024-01-31' - INTERVAL '48' HOUR THEN 'stale' ELSE 'active' END AS status FROM events GROUP BY 1")
def x5_stale(spark, d):
    seen = V.read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("seen")).withColumn("status", F.lit("active"))
    return S.stale(seen, "seen", V.at("2024-01-31 00:00:00"), 48).select("user_id", "status")


@register("x11_rate_windows", "SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n, least(count(*), 2) AS admitted FROM events GROUP BY 1, 2")
def x11_rate_windows(spark, d):
    return S.rate_windows(V.read(spark, d, "events"), "user_id", "ts", 2, "1 hour")


@register("x12_budget", """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS amount, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
 f AS (SELECT o_custkey, id, n, amount <= 900000 AS admitted, CASE WHEN amount <= 900000 THEN amount ELSE 0 END AS spent FROM o WHERE n = 1 UNION ALL
 SELECT o.o_custkey, o.id, o.n, f.spent + o.amount <= 900000, CASE WHEN f.spent + o.amount <= 900000 THEN f.spent + o.amount ELSE f.spent END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.n = f.n + 1) SELECT id, admitted, spent FROM f""")
def x12_budget(spark, d):
    orders = V.read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.round("o_totalprice").cast("bigint").alias("amount"), "o_orderdate")
    return S.fold_batch(orders, "o_custkey", ["o_orderdate", "id"], S.budget(900000), "id long, admitted boolean, spent long")


@register("x3_observation", """WITH o AS (SELECT l_partkey, l_orderkey * 8 + l_linenumber AS id, l_shipdate, l_suppkey % 3 AS owner, l_returnflag AS hash FROM lineitem),
 s AS (SELECT *, first_value(owner) OVER w AS first_owner, row_number() OVER w AS n FROM o WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, id, owner, hash)),
 p AS (SELECT *, lag(hash) OVER (PARTITION BY l_partkey, owner = first_owner ORDER BY l_shipdate, id, owner, hash) AS before FROM s)
 SELECT CASE WHEN n = 1 THEN 'create' WHEN owner <> first_owner THEN 'quarantine' WHEN hash = before THEN 'refresh' ELSE 'version' END AS action, id FROM p""")
def x3_observation(spark, d):
    rows = V.read(spark, d, "lineitem").select("l_partkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "l_shipdate", (F.col("l_suppkey") % 3).alias("owner"), F.col("l_returnflag").alias("hash"))
    folded = S.fold_batch(rows, "l_partkey", ["l_shipdate", "id", "owner", "hash"], S.catalog_observation(), "id long, action string, version long")
    return folded.select("action", "id")


@register("x9_enqueue", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label <> 3) AND doc_id % 10 <> 0")
def x9_enqueue(spark, d):
    docs = V.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("hash"))
    vectors = V.read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") != 3, 1).otherwise(0).alias("hash"))
    jobs = docs.filter("id % 10 = 0").select("id", F.lit("pending").alias("state"))
    return S.enqueue(docs, vectors, jobs).select("id")


@register("e12_drift", "WITH a AS (SELECT l_returnflag AS k, count(*) / sum(count(*)) OVER () AS s FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_returnflag AS k, count(*) / sum(count(*)) OVER () AS s FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) SELECT round(max(abs(coalesce(a.s, 0) - coalesce(b.s, 0))), 6) AS drift FROM a FULL JOIN b USING (k)")
def e12_drift(spark, d):
    rows = V.read(spark, d, "lineitem").select("l_returnflag", "l_linestatus")
    return E.share_drift(rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'"), "l_returnflag").select(F.round("drift", 6).alias("drift"))


@register("e21_transitions", "SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND before = 'view') AS direct, count(*) FILTER (WHERE before IS NULL) AS first FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY 1")
def e21_transitions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = V.read(spark, d, "events").withColumn("before", F.lag("event_type").over(w))
    return rows.groupBy("user_id").agg(F.count_if((F.col("event_type") == "purchase") & (F.col("before") == "view")).alias("direct"), F.count_if(F.col("before").isNull()).alias("first"))

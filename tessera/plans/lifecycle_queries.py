"""Registered queries over catalog writes, jobs, ledgers and lookups, each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.operators import lifecycle as L
from tessera.operators import retrieval as R
from tessera.sources import views as V
from tessera.streaming import folds as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


@register("x3_observe", """WITH e AS (SELECT user_id AS key, event_id AS id, event_id % 11 = 0 AS owner, event_type AS hash, value > 20 AS activate, event_id % 3 = 0 AS rej FROM events),
 f AS (SELECT *, first_value(owner) OVER (PARTITION BY key ORDER BY id) AS fo, row_number() OVER (PARTITION BY key ORDER BY id) = 1 AS isf FROM e),
 st AS (SELECT key, hash, min(id) AS since FROM f WHERE isf OR owner <> fo OR NOT rej GROUP BY 1, 2),
 g AS (SELECT f.*, coalesce(since < id, FALSE) AS known FROM f LEFT JOIN st USING (key, hash)),
 h AS (SELECT *, owner = fo AND NOT isf AND NOT known AND rej AS rejected FROM g),
 k AS (SELECT a.key, a.id, arg_max(p.hash, p.id) AS active FROM h a JOIN h p ON p.key = a.key AND p.id < a.id WHERE p.owner = p.fo AND p.activate AND NOT p.rejected GROUP BY 1, 2)
 SELECT h.key, h.id, CASE WHEN owner <> fo THEN 'quarantined' WHEN isf THEN CASE WHEN activate THEN 'indexed' ELSE 'pending' END WHEN rejected THEN 'rejected' WHEN known AND active = hash THEN 'refreshed' WHEN activate THEN 'versioned' ELSE 'pending' END AS outcome,
 CASE WHEN owner = fo AND activate AND NOT rejected THEN hash ELSE active END AS active_hash FROM h LEFT JOIN k USING (key, id)""")  # fmt: skip
def x3_observe(spark, d):
    e = F.col("event_id")
    rows = V.read(spark, d, "events").select(F.col("user_id").alias("key"), e.alias("id"), (e % 11 == 0).alias("owner"), F.col("event_type").alias("hash"), (F.col("value") > 20).alias("activate"), (e % 3 == 0).alias("reject_changes"))
    return L.observe(rows)


@register("x4_option_history", """WITH e AS (SELECT user_id, event_type AS option_hash, event_id AS id FROM events), s AS (SELECT user_id, option_hash, min(id) AS created_version, max(id) AS last FROM e GROUP BY 1, 2)
 SELECT s.user_id, s.option_hash, created_version, min(e.id) AS retired_version FROM s LEFT JOIN e ON e.user_id = s.user_id AND e.id > s.last GROUP BY 1, 2, 3""")  # fmt: skip
def x4_option_history(spark, d):
    rows = V.read(spark, d, "events").select("user_id", F.col("event_type").alias("option_hash"), F.col("event_id").alias("id"))
    return L.option_history(rows, ["user_id"])


@register("x17_override", """WITH o AS (SELECT o_custkey AS key, arg_max(CASE o_orderstatus WHEN 'F' THEN 'disabled' ELSE 'active' END, o_orderkey) AS s, arg_max(o_orderpriority, o_orderkey) AS r, max(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
 SELECT c_custkey AS key, coalesce(s, lower(c_mktsegment)) AS status, r AS quarantine_reason, coalesce(v, 0) AS updated_version FROM customer LEFT JOIN o ON key = c_custkey""")  # fmt: skip
def x17_override(spark, d):
    base = V.read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lower("c_mktsegment").alias("status"), F.lit(0).cast("long").alias("updated_version"))
    status = F.when(F.col("o_orderstatus") == "F", "disabled").when(F.col("o_orderstatus") == "O", "active").otherwise("unheard of")
    events = V.read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), status.alias("status"), F.col("o_orderpriority").alias("reason"))
    return L.override_status(base, events).select("key", "status", "quarantine_reason", "updated_version")


@register("x8_store", """WITH j AS (SELECT o_orderkey AS job, o_custkey % 7 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS fence, o_custkey AS document FROM orders WHERE o_orderkey % 9 <> 0)
 SELECT o_orderkey AS job, CASE WHEN o_orderkey % 10 = 0 THEN 'wrong_dimension' WHEN j.fence IS NULL OR j.fence <> o_custkey % 7 THEN 'fenced' WHEN c_custkey IS NULL OR c_nationkey % 3 <> o_custkey % 3 THEN 'requeued' ELSE 'stored' END AS outcome
 FROM orders LEFT JOIN j ON job = o_orderkey LEFT JOIN customer ON c_custkey = j.document""")  # fmt: skip
def x8_store(spark, d):
    orders, k, c = V.read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    results = orders.select(k.alias("job"), (c % 7).alias("fence"), (c % 3).alias("source_hash"), F.when(k % 10 == 0, 63).otherwise(64).alias("size"))
    jobs = orders.filter(k % 9 != 0).select(k.alias("job"), (c % 7 + F.when(k % 5 == 0, 1).otherwise(0)).alias("fence"), c.alias("document"))
    documents = V.read(spark, d, "customer").select(F.col("c_custkey").alias("document"), (F.col("c_nationkey") % 3).alias("source_hash"))
    return L.store_results(results, jobs, documents, 64).select("job", "outcome")


@register("x2_commit_versions", "SELECT event_id, row_number() OVER (ORDER BY date_trunc('hour', ts), event_id) AS version FROM events")
def x2_commit_versions(spark, d):
    rows = V.read(spark, d, "events").select("event_id", F.date_trunc("hour", "ts").alias("hour"))
    return L.commit_versions(rows, "hour", "event_id").select("event_id", "version")


@register("x2_watermark", "SELECT CAST(coalesce(min(v) FILTER (WHERE value > 450) - 1, max(v)) AS BIGINT) AS watermark FROM (SELECT value, row_number() OVER (ORDER BY date_trunc('hour', ts), event_id) AS v FROM events)")
def x2_watermark(spark, d):
    rows = V.read(spark, d, "events").select("event_id", "value", F.date_trunc("hour", "ts").alias("hour"))
    return L.watermark(L.commit_versions(rows, "hour", "event_id"), F.col("value") <= 450)


@register("x15_settlement", """WITH r AS (SELECT *, first_value(event_id) OVER w AS f, first_value(event_type) OVER w AS p, first_value(ts) OVER w AS t, first_value(value) OVER w AS v FROM (SELECT *, user_id * 4 + event_id % 4 AS key FROM events) WINDOW w AS (PARTITION BY key ORDER BY event_id))
 SELECT event_id AS id, CASE WHEN event_id = f THEN 'owner' WHEN event_type <> p THEN 'conflict' WHEN v > 30 AND t + INTERVAL 6 DAY <= ts THEN 'cached' WHEN t + INTERVAL 3 DAY < ts THEN 'resume' ELSE 'wait' END AS decision FROM r""")  # fmt: skip
def x15_settlement(spark, d):
    e = V.read(spark, d, "events")
    rows = e.select((F.col("user_id") * 4 + F.col("event_id") % 4).alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("payload"), F.col("ts").alias("at"),
                    F.when(F.col("value") > 30, F.col("ts") + F.expr("interval 6 days")).alias("completed_at"), (F.col("ts") + F.expr("interval 3 days")).alias("lease_until"))
    return L.settlement_state(rows).select("id", "decision")


@register("x16_leases", """WITH c AS (SELECT s_suppkey, row_number() OVER (ORDER BY round(s_acctbal), s_suppkey) AS n FROM supplier WHERE s_nationkey % 4 <> 1), r AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS n FROM nation)
 SELECT n_nationkey AS request, s_suppkey AS channel FROM r LEFT JOIN c USING (n)""")
def x16_leases(spark, d):
    until = F.when(F.col("s_nationkey") % 4 == 1, V.at("2999-01-01 00:00:00")).when(F.col("s_nationkey") % 4 == 2, V.at("1990-01-01 00:00:00"))
    channels = V.read(spark, d, "supplier").select(F.col("s_suppkey").alias("channel"), F.round("s_acctbal").alias("updated_at"), until.alias("lease_until"))
    return L.lease_channels(channels, V.read(spark, d, "nation").select(F.col("n_nationkey").alias("request")), V.at(V.AS_OF))


@register("e21_ledger", """WITH s AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
 SELECT event_id, coalesce((b IS NULL AND event_type IN ('signup', 'view')) OR (b = 'signup' AND event_type = 'view') OR (b = 'view' AND event_type IN ('click', 'view')) OR (b = 'click' AND event_type IN ('purchase', 'view')) OR (b = 'purchase' AND event_type = 'view'), FALSE) AS legal FROM s""")  # fmt: skip
def e21_ledger(spark, d):
    legal = {None: ("signup", "view"), "signup": ("view",), "view": ("click", "view"), "click": ("purchase", "view"), "purchase": ("view",)}
    rows = V.read(spark, d, "events").select("event_id", F.col("user_id").alias("run"), F.col("event_id").alias("id"), F.col("event_type").alias("state"))
    return L.ledger_check(rows, legal).select("event_id", "legal")


@register("d14_version_hash", """WITH o AS (SELECT l_orderkey, string_agg(h, '|' ORDER BY h) AS hs FROM (SELECT l_orderkey, sha256(CAST(l_partkey AS VARCHAR)) AS h FROM lineitem) GROUP BY 1)
 SELECT o_orderkey, sha256(sha256(o_orderpriority) || '|' || coalesce(hs, '')) AS version_hash FROM orders LEFT JOIN o ON l_orderkey = o_orderkey""")
def d14_version_hash(spark, d):
    options = V.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.sha2(F.col("l_partkey").cast("string"), 256)).alias("options"))
    rows = V.read(spark, d, "orders").join(options, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rows = rows.withColumns({"declaration": F.sha2("o_orderpriority", 256), "options": F.coalesce("options", F.array().cast("array<string>"))})
    return rows.select("o_orderkey", L.version_hash("declaration", "options").alias("version_hash"))


@register("d14_mismatches", """SELECT p_partkey, list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'name' END, CASE WHEN p_size % 3 = 0 THEN 'brand' END, CASE WHEN p_size > 25 THEN 'size' END], lambda x: x IS NOT NULL) AS mismatches FROM part""")
def d14_mismatches(spark, d):
    told = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("brand"), F.least("p_size", F.lit(25)).alias("size"))
    live = F.struct(F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return V.read(spark, d, "part").select("p_partkey", told.alias("told"), live.alias("live")).select("p_partkey", L.mismatches("told", "live", ["name", "brand", "size"]).alias("mismatches"))


@register("s3_natural_keys", """WITH r AS (SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'mcp' ELSE 'http' END AS type, url, CASE WHEN page_id % 3 = 0 THEN 't' || page_id % 4 ELSE '' END AS tool, page_id % 100 AS created, CASE WHEN page_id % 5 = 0 THEN page_id % 100 + 20 END AS retired FROM pages),
 l AS (SELECT type, url, tool, max(id) AS id FROM r WHERE created <= 60 AND (retired IS NULL OR retired > 60) GROUP BY 1, 2, 3) SELECT DISTINCT r.type, r.url, r.tool, l.id FROM r LEFT JOIN l ON l.type = r.type AND l.url = r.url AND l.tool = r.tool""")  # fmt: skip
def s3_natural_keys(spark, d):
    k = F.col("page_id")
    rows = V.read(spark, d, "pages").select(k.alias("id"), F.when(k % 3 == 0, "mcp").otherwise("http").alias("type"), "url", F.when(k % 3 == 0, F.concat(F.lit("t"), k % 4)).otherwise("").alias("tool"), (k % 100).alias("created_version"), F.when(k % 5 == 0, k % 100 + 20).alias("retired_version"))
    from tessera.operators.catalog import in_snapshot

    return L.natural_keys(rows, rows.select("type", "url", "tool").distinct(), in_snapshot(60))


@register("a17_queue_coverage", """WITH d AS (SELECT p_partkey AS document, p_size % 5 AS h FROM part), v AS (SELECT DISTINCT l_partkey AS document, CAST(l_quantity AS BIGINT) % 5 AS h FROM lineitem WHERE l_returnflag = 'R'),
 i AS (SELECT count(*) AS expected, count(v.h) AS indexed FROM d LEFT JOIN v USING (document, h)), s AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed FROM orders)
 SELECT expected, indexed, pending, failed, expected = indexed AND pending = 0 AND failed = 0 AS complete FROM i, s""")  # fmt: skip
def a17_queue_coverage(spark, d):
    documents = V.read(spark, d, "part").select(F.col("p_partkey").alias("document"), (F.col("p_size") % 5).alias("source_hash"))
    vectors = V.read(spark, d, "lineitem").select(F.col("l_partkey").alias("document"), (F.col("l_quantity").cast("bigint") % 5).cast("int").alias("source_hash"), F.when(F.col("l_returnflag") == "R", "ready").otherwise("failed").alias("status"))
    state = F.when(F.col("o_orderstatus") == "P", "leased").when(F.col("o_orderstatus") == "F", "dead").otherwise("done")
    return L.queue_coverage(documents, vectors, V.read(spark, d, "orders").select(state.alias("state")))


@register("a17_queue_depth", "SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY 1")
def a17_queue_depth(spark, d):
    return V.read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))


@register("r22_sessions", """WITH p AS (SELECT user_id AS session_id, event_type AS query, max(ts) AS latest, min(ts) AS since, list(event_id ORDER BY event_id % 10, event_id) AS page FROM events GROUP BY 1, 2)
 SELECT session_id, count(*) AS queries, arg_max(page, latest) AS shown, min(since) AS first_seen, max(latest) AS last_seen FROM p GROUP BY 1""")  # fmt: skip
def r22_sessions(spark, d):
    e = V.read(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("query"), F.col("event_id").alias("resource_id"), (F.col("event_id") % 10).alias("position"), F.col("ts").alias("created_at"))
    return L.upsert_sessions(e)


@register("o7_partial", """WITH c AS (SELECT c_nationkey, count(*) AS matched, count(*) FILTER (WHERE c_nationkey % 3 = 0 AND c_mktsegment = 'MACHINERY') AS vanished FROM customer GROUP BY 1)
 SELECT c_nationkey, 40 + least(20, greatest(matched - 40, 0)) + vanished < matched OR vanished > 0 OR c_nationkey % 4 = 0 AS partial FROM c""")
def o7_partial(spark, d):
    c = V.read(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("matched"), F.count_if((F.col("c_nationkey") % 3 == 0) & (F.col("c_mktsegment") == "MACHINERY")).alias("vanished"))
    shown = F.least(F.lit(20), F.greatest(F.col("matched") - 40, F.lit(0)))
    return c.select("c_nationkey", R.partial_results(shown, F.col("matched"), F.lit(40), F.col("vanished"), F.col("c_nationkey") % 4 == 0).alias("partial"))


@register("r15_degradation", """WITH s AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'hybrid' WHEN 1 THEN 'semantic' ELSE 'lexical' END AS wanted, CASE o_orderkey % 4 WHEN 0 THEN 'timeout' ELSE 'ok' END AS lex, CASE o_custkey % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'unavailable' ELSE 'ok' END AS sem FROM orders)
 SELECT o_orderkey, CASE WHEN wanted = 'hybrid' AND lex = 'ok' AND sem = 'ok' THEN 'hybrid' WHEN wanted = 'lexical' THEN CASE WHEN lex = 'ok' THEN 'lexical' ELSE 'none' END WHEN wanted = 'semantic' AND sem = 'ok' THEN 'semantic' WHEN lex = 'ok' THEN 'lexical' WHEN sem = 'ok' THEN 'semantic' ELSE 'none' END AS mode,
 array_to_string(list_filter([CASE WHEN lex <> 'ok' THEN 'lexical=' || lex END, CASE WHEN sem <> 'ok' THEN 'semantic=' || sem END], lambda x: x IS NOT NULL), ',') AS degraded FROM s""")  # fmt: skip
def r15_degradation(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    wanted = F.when(k % 3 == 0, "hybrid").when(k % 3 == 1, "semantic").otherwise("lexical")
    states = {"lexical": F.when(k % 4 == 0, "timeout").otherwise("ok"), "semantic": F.when(c % 4 == 0, "error").when(c % 4 == 1, "unavailable").otherwise("ok")}
    shown = F.array_join(F.transform(F.map_entries(R.degraded(states)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return V.read(spark, d, "orders").select("o_orderkey", R.effective_modes(wanted, states["lexical"] == "ok", states["semantic"] == "ok").alias("mode"), shown.alias("degraded"))


@register("x12_two_scopes", """WITH RECURSIVE o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_custkey % 5 AS scope, o_orderkey AS id, CAST(round(o_totalprice) AS BIGINT) AS amount, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS n FROM orders),
 f AS (SELECT day, id, n, amount <= 400000 AND amount <= 900000 AS admitted, CASE WHEN amount <= 400000 THEN amount ELSE 0 END AS everyone, [CASE WHEN scope = i AND amount <= 400000 THEN amount ELSE 0 END FOR i IN range(5)] AS own FROM o WHERE n = 1 UNION ALL
 SELECT o.day, o.id, o.n, f.own[o.scope + 1] + o.amount <= 400000 AND f.everyone + o.amount <= 900000, CASE WHEN f.own[o.scope + 1] + o.amount <= 400000 AND f.everyone + o.amount <= 900000 THEN f.everyone + o.amount ELSE f.everyone END,
 CASE WHEN f.own[o.scope + 1] + o.amount <= 400000 AND f.everyone + o.amount <= 900000 THEN [f.own[i + 1] + CASE WHEN o.scope = i THEN o.amount ELSE 0 END FOR i IN range(5)] ELSE f.own END FROM f JOIN o ON o.day = f.day AND o.n = f.n + 1) SELECT id, admitted, everyone AS spent FROM f""")  # fmt: skip
def x12_two_scopes(spark, d):
    orders = V.read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 5).alias("scope"), F.col("o_orderkey").alias("id"), F.round("o_totalprice").cast("bigint").alias("amount"))
    return S.fold_batch(orders, "day", ["id"], S.two_scope_budget(400000, 900000), "id long, admitted boolean, spent long")


@register("j6_conversion_window", f"""WITH {V.IMPRESSIONS} SELECT count(*) AS impressions, count(DISTINCT session_id) AS sessions FROM impressions WHERE created_at >= TIMESTAMP '{V.EVENTS_AS_OF}' - INTERVAL 24 HOUR - INTERVAL 5 DAY""")
def j6_conversion_window(spark, d):
    rows = A.recent_impressions(V.impressions(spark, d), V.EVENTS_AS_OF, 24, 5)
    return rows.agg(F.count("*").alias("impressions"), F.count_distinct("session_id").alias("sessions"))

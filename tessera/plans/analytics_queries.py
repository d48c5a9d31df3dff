"""Registered queries over the payment, site and impression views, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.sources import views as V
from tessera.sources.views import AS_OF, IMPRESSIONS, PAYMENTS, SITE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SET = "stage = 'settled'"
OK = "status = 'success'"
AMOUNT = f"CAST(coalesce(sum(amount) FILTER (WHERE {OK}), 0) AS DECIMAL(38,0))"
DAYS = 400


def since(days: int) -> str:
    return f"occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL '{days}' DAY"


def register(name: str, sql: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return put


@register("a1_overview", f"""WITH {PAYMENTS} SELECT count(*) FILTER (WHERE {SET}) AS total_transactions, count(*) FILTER (WHERE {SET} AND {OK}) AS successful_transactions,
 count(*) FILTER (WHERE {SET} AND status = 'failed') AS failed_transactions, count(*) FILTER (WHERE stage = 'verified') AS total_verifications,
 CAST(coalesce(sum(amount) FILTER (WHERE {SET} AND {OK}), 0) AS DECIMAL(38,0)) AS total_amount, CAST(coalesce(sum(fee) FILTER (WHERE {SET}), 0) AS DECIMAL(38,0)) AS total_fee,
 count(DISTINCT payer) FILTER (WHERE {SET}) AS unique_buyers, count(DISTINCT pay_to) FILTER (WHERE {SET}) AS unique_sellers, count(DISTINCT facilitator_id) AS unique_facilitators,
 count(DISTINCT network) AS unique_networks, count(DISTINCT resource_id) AS unique_resources, max(occurred_at) AS latest_activity, min(occurred_at) AS first_activity FROM payments WHERE {since(DAYS)}""")
def a1_overview(spark, d):
    return A.overview(V.payments(spark, d), DAYS, AS_OF)


@register("a2_catalog_counts", f"WITH {V.RESOURCES} SELECT count(*) AS cataloged, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'stale') AS stale, count(*) FILTER (WHERE status = 'quarantined') AS quarantined, count(DISTINCT origin) AS origins FROM resources")
def a2_catalog_counts(spark, d):
    return A.catalog_counts(V.resources(spark, d))


for _bucket in ("day", "hour"):
    @register(f"a3_timeseries_{_bucket}", f"WITH {PAYMENTS} SELECT CAST(date_trunc('{_bucket}', occurred_at) AS TIMESTAMP) AS bucket_start, count(*) AS total_transactions, {AMOUNT} AS total_amount, count(DISTINCT payer) AS unique_buyers, count(DISTINCT pay_to) AS unique_sellers FROM payments WHERE {SET} AND {since(DAYS)} GROUP BY 1")
    def a3_timeseries(spark, d, bucket=_bucket):
        return A.timeseries(V.payments(spark, d), bucket, DAYS, AS_OF)


for _role, _own, _other in (("buyer", "payer", "pay_to"), ("seller", "pay_to", "payer")):
    _board = f"SELECT {_own} AS address, count(*) AS tx_count, {AMOUNT} AS total_amount, count(DISTINCT {_other}) AS unique_counterparties, count(DISTINCT network) AS unique_networks, list_sort(list(DISTINCT network)) AS networks, list_sort(list(DISTINCT facilitator_id)) AS facilitators, max(occurred_at) AS latest_activity FROM payments WHERE {SET} AND {_own} IS NOT NULL GROUP BY 1"

    @register(f"a4_participants_{_role}", f"WITH {PAYMENTS} {_board}")
    def a4_participants(spark, d, role=_role):
        return A.participants(V.payments(spark, d), role, 0, AS_OF)

    @register(f"a4_top_{_role}s", f"WITH {PAYMENTS} {_board} ORDER BY total_amount DESC, tx_count DESC, address LIMIT 20")
    def a4_top(spark, d, role=_role):
        return A.page_of(A.participants(V.payments(spark, d), role, 0, AS_OF), 20, 0)

    @register(f"a5_participant_count_{_role}", f"WITH {PAYMENTS} SELECT count(DISTINCT {_own}) AS total FROM payments WHERE {SET} AND {since(DAYS)}")
    def a5_count(spark, d, role=_role):
        return A.participant_count(V.payments(spark, d), role, DAYS, AS_OF)

    @register(f"a6_concentration_{_role}", f"""WITH {PAYMENTS}, t AS (SELECT {_own} AS address, coalesce(sum(amount) FILTER (WHERE {OK}), 0) AS amount, count(*) AS transactions FROM payments WHERE {SET} GROUP BY 1),
 r AS (SELECT *, row_number() OVER (ORDER BY amount DESC, address) AS p FROM t) SELECT CAST(sum(amount) AS DECIMAL(38,0)) AS total_amount, CAST(sum(amount) FILTER (WHERE p <= 1) AS DECIMAL(38,0)) AS top1_amount, CAST(sum(amount) FILTER (WHERE p <= 5) AS DECIMAL(38,0)) AS top5_amount,
 CAST(sum(amount) FILTER (WHERE p <= 10) AS DECIMAL(38,0)) AS top10_amount, CAST(sum(transactions) AS BIGINT) AS total_transactions, CAST(sum(transactions) FILTER (WHERE p <= 5) AS BIGINT) AS top5_transactions, count(*) AS participants FROM r""")
    def a6_concentration(spark, d, role=_role):
        return A.concentration(V.payments(spark, d), role, 0, AS_OF)

    @register(f"a7_detail_{_role}", f"WITH {PAYMENTS} SELECT count(*) AS tx_count, count(*) FILTER (WHERE {OK}) AS successful, {AMOUNT} AS total_amount, count(DISTINCT {_other}) AS unique_counterparties, list_sort(list(DISTINCT network)) AS networks, list_sort(list(DISTINCT scheme)) AS schemes, min(occurred_at) AS first_activity, max(occurred_at) AS latest_activity FROM payments WHERE {SET} AND {_own} = 42")
    def a7_detail(spark, d, role=_role):
        return A.participant_detail(V.payments(spark, d), role, 42, 0, AS_OF)

    @register(f"a8_counterparties_{_role}", f"WITH {PAYMENTS} SELECT {_other} AS address, count(*) AS tx_count, {AMOUNT} AS total_amount, list_sort(list(DISTINCT network)) AS networks, max(occurred_at) AS latest_activity FROM payments WHERE {SET} AND {_own} = 42 GROUP BY 1")
    def a8_counterparties(spark, d, role=_role):
        return A.counterparties(V.payments(spark, d), role, 42, 0, AS_OF)


@register("a9_breakdowns", "WITH " + PAYMENTS + " " + " UNION ALL ".join(f"SELECT '{k}' AS dimension, {k} AS key, count(*) AS tx_count, {AMOUNT} AS total_amount, count(DISTINCT payer) AS unique_buyers, count(DISTINCT pay_to) AS unique_sellers, count(DISTINCT facilitator_id) AS unique_facilitators, max(occurred_at) AS latest_activity FROM payments WHERE {SET} AND {since(DAYS)} GROUP BY 2" for k in ("network", "scheme", "asset", "status")))
def a9_breakdowns(spark, d):
    return A.breakdowns(V.payments(spark, d), DAYS, AS_OF)


_ROLLUP = f"SELECT CAST(occurred_at AS DATE) AS usage_day, network, scheme, asset, pay_to, status, count(*) AS transactions, {AMOUNT} AS amount, CAST(sum(fee) AS DECIMAL(38,0)) AS fee FROM payments WHERE {SET} GROUP BY 1, 2, 3, 4, 5, 6"


@register("x1_daily_totals", f"WITH {PAYMENTS} {_ROLLUP}")
def x1_daily_totals(spark, d):
    return A.daily_totals(V.payments(spark, d))


@register("a10_daily_volume", f"WITH {PAYMENTS}, r AS ({_ROLLUP}) SELECT usage_day, network, scheme, asset, status, CAST(sum(transactions) AS BIGINT) AS transactions, CAST(sum(amount) AS DECIMAL(38,0)) AS amount, CAST(sum(fee) AS DECIMAL(38,0)) AS fee FROM r WHERE usage_day >= DATE '{AS_OF[:10]}' - {DAYS} GROUP BY 1, 2, 3, 4, 5")
def a10_daily_volume(spark, d):
    return A.daily_volume(A.daily_totals(V.payments(spark, d)), DAYS, AS_OF)


@register("a11_observability", f"WITH {PAYMENTS} SELECT resource_id, count(*) AS calls_all_time, count(*) FILTER (WHERE {OK}) AS success_all_time, count(*) FILTER (WHERE status = 'failed') AS failed_all_time, count(DISTINCT payer) AS unique_buyers, {AMOUNT} AS total_amount, "
          + ", ".join(f"count(*) FILTER (WHERE occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL '{h}' HOUR) AS calls_{h}h, count(*) FILTER (WHERE {OK} AND occurred_at >= TIMESTAMP '{AS_OF}' - INTERVAL '{h}' HOUR) AS success_{h}h" for h in A.OBSERVED_HOURS) + f" FROM payments WHERE {SET} AND resource_id IS NOT NULL GROUP BY 1")
def a11_observability(spark, d):
    return A.observability(V.payments(spark, d), AS_OF)


_FLAGS = "f AS (SELECT *, EXISTS (SELECT 1 FROM conversions e WHERE e.resource_id = i.resource_id AND e.stage = 'settled' AND e.occurred_at BETWEEN i.created_at AND i.created_at + INTERVAL '24' HOUR) AS settled, EXISTS (SELECT 1 FROM conversions e WHERE e.resource_id = i.resource_id AND e.stage = 'verified' AND e.occurred_at BETWEEN i.created_at AND i.created_at + INTERVAL '24' HOUR) AS verified FROM impressions i)"


@register("j6_interval_existence", f"WITH {IMPRESSIONS}, {_FLAGS} SELECT id, verified, settled FROM f")
def j6_interval_existence(spark, d):
    return A.conversion_flags(V.impressions(spark, d), V.conversions(spark, d), 24).select("id", "verified", "settled")


@register("a12_conversion", f"WITH {IMPRESSIONS}, {_FLAGS} SELECT count(*) AS impressions, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE verified) AS verified_impressions, count(*) FILTER (WHERE settled) AS settled_impressions, count(*) FILTER (WHERE settled AND position <= 1) AS settled_at_position_1, count(*) FILTER (WHERE settled AND position <= 3) AS settled_within_top_3, count(*) FILTER (WHERE settled AND position <= 5) AS settled_within_top_5 FROM f WHERE created_at >= TIMESTAMP '{V.EVENTS_AS_OF}' - INTERVAL 24 HOUR - INTERVAL 30 DAY")
def a12_conversion(spark, d):
    return A.conversion(A.conversion_flags(A.recent_impressions(V.impressions(spark, d), V.EVENTS_AS_OF, 24), V.conversions(spark, d), 24))


@register("a13_conversion_by_mode", f"WITH {IMPRESSIONS} SELECT mode, reranked, count(*) AS impressions, count(DISTINCT session_id) AS sessions, CAST(round(avg(latency_ms)) AS INTEGER) AS avg_latency_ms, count(*) FILTER (WHERE json_extract_string(degraded, '$.semantic') IN ('timeout','error','unavailable')) AS semantic_fallbacks, count(*) FILTER (WHERE json_extract_string(degraded, '$.reranking') IN ('timeout','error','unavailable')) AS rerank_fallbacks FROM impressions WHERE created_at >= TIMESTAMP '{V.EVENTS_AS_OF}' - INTERVAL 24 HOUR - INTERVAL 30 DAY GROUP BY 1, 2")
def a13_conversion_by_mode(spark, d):
    return A.conversion_by_mode(A.recent_impressions(V.impressions(spark, d), V.EVENTS_AS_OF, 24))


@register("a14_origins", f"WITH {PAYMENTS}, {V.RESOURCES}, e AS (SELECT resource_id, count(*) AS n, coalesce(sum(amount) FILTER (WHERE {OK}), 0) AS a FROM payments WHERE {SET} GROUP BY 1) SELECT origin, count(*) AS resources, count(*) FILTER (WHERE status = 'active') AS active_resources, CAST(coalesce(sum(n), 0) AS BIGINT) AS tx_count, CAST(coalesce(sum(a), 0) AS DECIMAL(38,0)) AS total_amount FROM resources LEFT JOIN e ON resource_id = id GROUP BY 1")
def a14_origins(spark, d):
    return A.origins(V.resources(spark, d), V.payments(spark, d))


@register("a15_site_summary", f"WITH {SITE} SELECT count(DISTINCT visitor) AS visitors, count(DISTINCT (visitor, page_path)) AS visits, count(*) FILTER (WHERE event_type = 'page_view') AS page_views, count(*) FILTER (WHERE event_type = 'impression') AS impressions FROM site")
def a15_site_summary(spark, d):
    return A.site_summary(V.site_events(spark, d))


@register("a16_site_daily", f"WITH {SITE} SELECT CAST(occurred_at AS DATE) AS day, count(DISTINCT visitor) AS visitors, count(*) FILTER (WHERE event_type = 'page_view') AS page_views FROM site GROUP BY 1")
def a16_site_daily(spark, d):
    return A.site_daily(V.site_events(spark, d))


@register("a16_top_pages", f"WITH {SITE} SELECT page_path, count(*) FILTER (WHERE event_type = 'page_view') AS views, count(DISTINCT visitor) AS visits FROM site GROUP BY 1 ORDER BY views DESC, visits DESC, page_path LIMIT 20")
def a16_top_pages(spark, d):
    return A.top_pages(V.site_events(spark, d))


@register("d13_zero_filled", f"WITH {SITE}, c AS (SELECT CAST(unnest(generate_series(DATE '2024-02-05' - 44, DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day), s AS (SELECT CAST(occurred_at AS DATE) AS day, count(DISTINCT visitor) AS visitors, count(*) FILTER (WHERE event_type = 'page_view') AS page_views FROM site GROUP BY 1) SELECT day, coalesce(visitors, 0) AS visitors, coalesce(page_views, 0) AS page_views FROM c LEFT JOIN s USING (day)")
def d13_zero_filled(spark, d):
    return A.zero_filled(A.site_daily(V.site_events(spark, d)), "day", ["visitors", "page_views"], 45, "2024-02-05")


@register("p1_transactions_page", f"WITH {PAYMENTS}, m AS (SELECT * FROM payments WHERE {SET} AND network = 'ASIA' AND status = 'success') SELECT *, (SELECT count(*) FROM m) AS total FROM m ORDER BY occurred_at DESC, id DESC LIMIT 20 OFFSET 40")
def p1_transactions_page(spark, d):
    return A.transactions(V.payments(spark, d), 20, 40, network="ASIA", status="success", payer=None)


@register("s2_latest_by_key", f"WITH {PAYMENTS} SELECT * FROM payments WHERE payer = 42 ORDER BY occurred_at DESC, id DESC LIMIT 1")
def s2_latest_by_key(spark, d):
    return A.latest_by(V.payments(spark, d), "payer", 42)


@register("j15_full_keys", f"WITH {PAYMENTS}, o AS (SELECT network, count(*) AS n FROM payments WHERE network <> 'ASIA' GROUP BY 1), c AS (SELECT r_name AS network FROM region WHERE r_name <> 'EUROPE') SELECT coalesce(o.network, c.network) AS network, coalesce(n, 0) AS n, c.network IS NOT NULL AS configured FROM o FULL JOIN c ON o.network = c.network")
def j15_full_keys(spark, d):
    observed = V.payments(spark, d).filter("network <> 'ASIA'").groupBy("network").agg(F.count("*").alias("n"))
    return A.full_keys(observed, V.read(spark, d, "region").filter("r_name <> 'EUROPE'").select(F.col("r_name").alias("network")), "network", "n")
